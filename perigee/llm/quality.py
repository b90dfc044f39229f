"""Quality rules as a short-circuit cascade.

What a rule costs and rejects is estimated on a bounded sample; rules then run in the order of
rejection per cost, each only on the documents that those before it let through. The order
changes the work and never the verdict, which is that no rule rejects. Measures that the result
has for every document cost a rule nothing more; others are made for what is left.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from perigee.llm.arrays import SPACE, Rolling, covered, fits, hash_spans, mix, runs_of, split_words, sum_per_text
from perigee.llm.rows import flat, rows_and_text, schema_with_row, slices

U = np.uint64
#: Documents that costs and selectivities are estimated on.
SAMPLE = 1000


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOLS = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_ALPHA = _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_MARKS = _table(b".!?")
_BEGINS = np.array([b & 0xC0 != 0x80 for b in range(256)])
#: Windows of so many words count as repeated.
REPEAT = 3


def measure(make: Callable[[Texts], object]) -> property:
    """A value per text, made once. Some texts taken out of others have it from those; what is
    not known yet is made for them alone if they are few, else for all they were taken from."""
    name = make.__name__

    def get(texts: Texts):
        held = texts.known(name)
        if held is None:
            held = make(texts) if texts.few() else _chosen(getattr(texts.source, name), texts.which)
        texts.made[name] = held
        return held

    return property(get, doc=make.__doc__)


def _chosen(held, which: np.ndarray):
    return tuple(x[which] for x in held) if isinstance(held, tuple) else held[which]


class Texts:
    """Texts one after another, and what rules measure of them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, source: Texts | None = None, which: np.ndarray | None = None):
        self._data, self._bounds, self.source, self.which = data, bounds, source, which
        self.made: dict[str, object] = {}

    def take(self, which: np.ndarray) -> Texts:
        return Texts(None, None, self, which)

    def known(self, name: str):
        if name in self.made or self.source is None:
            return self.made.get(name)
        held = self.source.known(name)
        return None if held is None else _chosen(held, self.which)

    def few(self) -> bool:
        """Whether it pays to copy these texts: they are under a quarter of their source."""
        if self.source is None:
            return True
        return 4 * int(np.diff(self.source.bounds)[self.which].sum()) < len(self.source.data)

    def _copy(self) -> None:
        if self._data is None:
            size = np.diff(self.source.bounds)
            chosen = np.zeros(len(size), bool)
            chosen[self.which] = True  # places ascend
            self._data = self.source.data[np.repeat(chosen, size)]
            self._bounds = np.concatenate([[0], np.cumsum(size[self.which])])

    @property
    def data(self) -> np.ndarray:
        self._copy()
        return self._data

    @property
    def bounds(self) -> np.ndarray:
        self._copy()
        return self._bounds

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes of a set in each text."""
        return sum_per_text(table[self.data].astype(np.int64), self.bounds)

    @cached_property
    def words(self):
        return split_words(self.data, self.bounds)

    @measure
    def n_words(self) -> np.ndarray:
        return self.words.per_text.astype(np.int64)

    @measure
    def word_chars(self) -> np.ndarray:
        return self.count(_BEGINS & ~SPACE)

    @measure
    def n_symbols(self) -> np.ndarray:
        return self.count(SYMBOLS)

    @measure
    def n_upper(self) -> np.ndarray:
        return self.count(_UPPER)

    @measure
    def n_marks(self) -> np.ndarray:
        return self.count(_MARKS)

    @measure
    def n_alpha_words(self) -> np.ndarray:
        words = self.words
        seen = np.concatenate([[0], np.cumsum(_ALPHA[self.data])])
        return sum_per_text((seen[words.ends] > seen[words.starts]).astype(np.int64), words.first)

    @measure
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: its lines with a word, and those equal to an earlier one."""
        n = len(self.bounds) - 1
        if not len(self.data):
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        feeds = np.flatnonzero(self.data == 10)
        starts = np.unique(np.concatenate([self.bounds[:-1], feeds + 1]))
        starts = starts[starts < len(self.data)]
        ends = np.append(starts[1:], len(self.data))
        ends = ends - (self.data[ends - 1] == 10)
        held = np.searchsorted(self.words.starts, ends) > np.searchsorted(self.words.starts, starts)
        starts, ends = starts[held], ends[held]
        text = np.searchsorted(self.bounds, starts, side="right") - 1
        key = mix(hash_spans(self.data, starts, ends) ^ mix(text.astype(U)))
        every = np.bincount(text, minlength=n)
        order = np.argsort(key, kind="stable")
        first = order[runs_of(key[order])]
        return every, every - np.bincount(text[first], minlength=n)

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self.lines[1]

    @measure
    def n_repeat_words(self) -> np.ndarray:
        """Words in windows of REPEAT words that a text has twice or more."""
        words = self.words
        at = np.flatnonzero(fits(words, REPEAT))
        window = Rolling(words.hashes()).windows(REPEAT)[at]
        key = mix(window ^ mix(words.text_of()[at].astype(U)))
        order = np.argsort(key, kind="stable")
        first = runs_of(key[order])
        size = np.diff(np.append(first, len(order)))
        again = order[np.repeat(size > 1, size)]
        return sum_per_text(covered(at[again], REPEAT, len(words.starts)).astype(np.int64), words.first)

    def base(self) -> list[np.ndarray]:
        """The measures that every document has in the result."""
        return [self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


#: Limits of the shipped rules.
RULES = (
    Rule("word_length", lambda t: (t.word_chars < 3 * t.n_words) | (t.word_chars > 10 * t.n_words)),
    Rule("symbols", lambda t: t.n_symbols * 10 > t.n_words),
    Rule("upper_case", lambda t: t.n_upper * 2 > t.word_chars),
    Rule("end_marks", lambda t: t.n_marks * 4 > 5 * t.n_words),
    Rule("letters", lambda t: t.n_alpha_words * 4 < 3 * t.n_words),
    Rule("same_lines", lambda t: t.n_dup_lines * 2 > t.lines[0]),
    Rule("same_windows", lambda t: t.n_repeat_words * 10 > 4 * t.n_words),
)


def base_fails(texts: Texts) -> np.ndarray:
    return (texts.n_words < 50) | (100 * texts.n_repeat_words > 50 * texts.n_words)


def order_rules(cost: np.ndarray, rejected: np.ndarray) -> list[int]:
    """The order of rules (columns of `rejected`, rows are sample documents): always the one
    next that rejects most of what is left for its cost; ties by place."""
    left, live, out = list(range(len(cost))), np.ones(len(rejected), bool), []
    while left:
        gain = [rejected[live, k].sum() / max(cost[k], 1e-9) for k in left]
        best = left.pop(int(np.argmax(gain)))
        out.append(best)
        live &= ~rejected[:, best]
    return out


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample: int = SAMPLE) -> tuple[Rule, ...]:
    """The rules in the order in which they should run, from at most `sample` random texts."""
    rows = rows_and_text(docs, text, [docs.columns[0]]).select("text")
    share = min(1.0, 2 * sample / max(1, docs.count()))  # tasks send on only what they draw
    chosen = rows.sample(share, 11).orderBy(F.rand(11)).limit(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            held = Texts(*flat(part.column("text")))
            held.base()
            cost, found = [], []
            for rule in rules:  # what a rule costs besides the measures of the result
                fresh, begin = Texts(held.data, held.bounds), time.perf_counter()
                fresh.made, fresh.words = dict(held.made), held.words
                found.append(rule.rejects(fresh))
                cost.append(time.perf_counter() - begin)
            yield pa.RecordBatch.from_pydict(
                {"cost": [cost], "rejected": [np.packbits(np.array(found), axis=None).tobytes()], "n": [part.num_rows]},
                pa.schema([("cost", pa.list_(pa.float64())), ("rejected", pa.binary()), ("n", pa.int64())]))

    seen = chosen.mapInArrow(measure, "cost array<double>, rejected binary, n long").collect()
    if not seen:
        return rules
    rejected = [np.unpackbits(np.frombuffer(r["rejected"], np.uint8), count=r["n"] * len(rules)).reshape(len(rules), -1).T for r in seen]
    order = order_rules(np.sum([r["cost"] for r in seen], axis=0), np.concatenate(rejected).astype(bool))
    return tuple(rules[k] for k in order)


def run_cascade(texts: Texts, rules: tuple[Rule, ...], live: np.ndarray) -> np.ndarray:
    """For each text how many rules it passed, of those that are live; others have none."""
    passed = np.zeros(len(live), np.int64)
    left = np.flatnonzero(live)
    for rule in rules:
        if not len(left):
            break
        left = left[~rule.rejects(texts if len(left) == len(live) else texts.take(left))]
        passed[left] += 1
    return passed


def judge_quality(docs: DataFrame, keep: list[str] | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: `row` (kept columns), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    Words stand between white space. base_failed: under 50 words, or more than half of them in
    3-word windows that the text has twice or more. `kept` is false for those and for texts
    that a rule of the cascade rejects. A null or empty text has no words and fails. Lines and
    windows are compared by 64-bit hashes within a text. Every row gives one row; an empty
    table gives none.
    """
    planned = plan_cascade(docs, rules, text)
    rows = rows_and_text(docs, text, keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = Texts(*flat(part.column("text")))
            columns, failed = texts.base(), base_fails(texts)
            kept = run_cascade(texts, planned, ~failed) == len(planned)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), *[pa.array(x, pa.int64()) for x in columns], pa.array(failed), pa.array(kept & ~failed)],
                ["row", *_COUNTS, "base_failed", "kept"])

    return rows.mapInArrow(work, schema_with_row(
        rows, *[(name, "long") for name in _COUNTS], ("base_failed", "boolean"), ("kept", "boolean")))


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
