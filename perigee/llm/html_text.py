"""HTML to visible text, laid out as a page would be.

A tree builder adds the end tags that HTML lets authors leave out; visibility rules then hide
what a browser would not show, and a renderer writes all other text: white space collapses
outside preformatted text, blocks stand on lines of their own, paragraphs, headings, lists and
tables keep a blank line around them, list items get a marker and an indent, and cells of a
table line up in columns. Everything is iterative: nesting has no limit.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from perigee.llm.rows import rows_and_text, schema_with_row, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and of these the ones whose text is shown.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style template noscript iframe noembed noframes title datalist audio video canvas object".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary"
    " table caption tbody td tfoot th thead tr ul xmp".split()
)
#: Blocks with a blank line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre figure hr xmp".split())
LISTS = frozenset("ul ol menu dir".split())
#: A start tag ends an open element of these kinds, unless one of the limits stands between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "caption": (("caption",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("optgroup", "option"), ("select",)),
    "body": (("head",), ()),
}
#: Elements that an end tag of an inline element outside of them does not close.
WALLS = frozenset("table td th caption button object template".split())
#: Brackets in a selector are read to this depth.
DEEPEST = 16
#: Columns are padded to this many characters at most; longer cells go beyond.
COLUMN, MOST_COLUMNS = 60, 1000

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_VISIBLE = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)
_DISPLAY = re.compile(r"\s*display\s*:\s*([^!]*?)\s*(!\s*important\s*)?\Z", re.I)
#: Comments, strings and the markers of a page comment in a style sheet; its pieces.
_ASIDE = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+'|<!--|-->""", re.S)
_PIECE = re.compile(r"((?:[^{};\\]++|\\.)*+\\?)([{};]|\Z)", re.S)
_PLAIN_MEDIA = re.compile(r"(?:(?:only\s+)?(?:all|screen)|not\s+(?:print|speech))?\Z")
_OFF_MEDIA = re.compile(r"(?:only\s+)?(?:print|speech|aural|braille|embossed|handheld|projection|tty|tv)\b|not\s+(?:all|screen)\Z")
_NAME = r"(?:[\w-]|\\.|[^\x00-\x7f])++"
_PART = re.compile(rf"[.#]?{_NAME}")
_COMPOUND = re.compile(rf"(?:\*|{_NAME})?+(?:[.#]{_NAME})*+\Z")
_OUTSIDE = re.compile(r"\([^()]*+\)|\[[^\[\]]*+\]")
_PSEUDO = re.compile(rf"(?<!\\)::?{_NAME}")
#: No element of a page that was just opened is in these states; the others are no elements.
_NEVER = re.compile(r"(?<!\\)(?:::|:(?:hover|focus|focus-within|focus-visible|active|target|before|after|first-line|first-letter)(?![\w-]))", re.I)


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


def _attributes(held: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(held):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


class Open:
    """The open elements, root first, and how many there are of each tag."""

    def __init__(self, root: Node):
        self.nodes, self.count = [root], {}

    @property
    def last(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def cut(self, i: int) -> None:
        for node in self.nodes[i:]:
            self.count[node.tag] -= 1
        del self.nodes[i:]

    def close(self, tags: tuple[str, ...], limits: tuple[str, ...]) -> None:
        """Ends the nearest open element of these tags, if no limit is nearer."""
        if not any(self.count.get(t) for t in tags):
            return
        for i in range(len(self.nodes) - 1, 0, -1):
            if self.nodes[i].tag in tags:
                return self.cut(i)
            if self.nodes[i].tag in limits:
                return

    def end(self, tag: str) -> None:
        """An end tag: of an inline element, it ends none beyond the nearest block."""
        if tag == "br":
            self.last.children.append(Node("br"))
        if not self.count.get(tag):
            return
        for i in range(len(self.nodes) - 1, 0, -1):
            held = self.nodes[i].tag
            if held == tag:
                return self.cut(i)
            if tag not in BLOCK and (held in BLOCK or held in WALLS) or held == "table" and tag not in ("body", "html"):
                return


def build(source: str) -> tuple[Node, Sheet]:
    """The tree of a page, and what its style sheets say about display."""
    root = Node("#root")
    stack, sheets, names = Open(root), [], set()
    at, end = 0, len(source)
    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            stack.last.children.append(html.unescape(source[at:lt]))
        if lt == end:
            break
        if source.startswith("<!--", lt):
            close = source.find("-->", lt + 2)
            at = end if close < 0 else close + 3
            continue
        if source[lt + 1 : lt + 2] in ("!", "?"):
            close = source.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        found = _TAG.match(source, lt) or _LOOSE.match(source, lt)
        if not found:
            if source[lt + 1 : lt + 2].isalpha() or source[lt + 1 : lt + 2] == "/" and source[lt + 2 : lt + 3].isalpha():
                break  # a tag that the end of the page cuts off
            stack.last.children.append("<")
            at = lt + 1
            continue
        at = found.end()
        closing, tag, held = found.group(1), found.group(2).lower(), found.group(3)
        if closing:
            stack.end(tag)
            continue
        if tag in ENDS:
            stack.close(*ENDS[tag])
        if tag in ("td", "th") and stack.last.tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack.last.children.append(row)
            stack.push(row)
        if tag in BLOCK and tag not in ("html", "body", "option", "optgroup"):
            stack.close(("p",), ("table", "td", "th", "button", "object", "caption"))
        node = Node(tag, _attributes(held) if held and not held.isspace() else {})
        stack.last.children.append(node)
        names.update(_names(node))
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            inner = source[at : close.start() if close else end]
            if tag == "style":
                sheets.append((inner, node.attributes.get("media", "")))
            node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            gt = source.find(">", close.start()) if close else -1
            at = end if gt < 0 else gt + 1
        elif tag not in VOID and not held.rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
            stack.push(node)
    return root, Sheet(sheets, names)


def _names(node: Node) -> list[str]:
    """What selectors call an element by: tag, id and classes."""
    a = node.attributes
    return [node.tag, *(["#" + a["id"]] if "id" in a else []), *("." + c for c in a.get("class", "").split())]


def _media(queries: str) -> bool | None:
    """Whether a media list holds on every screen (True), on some (None) or on none (False)."""
    held = [" ".join(q.lower().split()) for q in queries.split(",")]
    if any(_PLAIN_MEDIA.match(q) for q in held):
        return True
    return False if all(_OFF_MEDIA.match(q) for q in held) else None


def _at_rule(prelude: str) -> bool | None:
    """Whether the rules in the block of an at-rule hold."""
    name = re.match(r"@([\w-]*)", prelude).group(1).lower()
    if name == "media":
        return _media(prelude[6:])
    return True if name == "layer" else None if name in ("supports", "container", "scope") else False


def _display(declarations: list[str]) -> tuple[bool, bool] | None:
    """(important, shown) of the display that a block sets; the last one of most importance."""
    out = None
    for held in declarations:
        found = _DISPLAY.match(held)
        if found and found.group(1) and "\\" not in found.group(1):
            important = bool(found.group(2))
            if out is None or important >= out[0]:
                out = important, found.group(1).lower() != "none"
    return out


def _blocks(sheet: str, media: str) -> Iterator[tuple[str, bool | None, bool, tuple[bool, bool]]]:
    """Selectors, whether they hold, whether they are nested in a block, and the display they
    set. Nested ones hold for a part of the elements they name only."""
    stack: list = [(_media(media), "", False, [])]
    pieces = _PIECE.findall(_ASIDE.sub(lambda m: '""' if m[0][0] in "\"'" else " ", sheet))
    for held, mark in [*pieces, *[("", "}")] * (sum(m == "{" for _, m in pieces) + 1)]:
        holds, selectors, nested, declarations = stack[-1]
        if mark == "{":
            held = held.strip()
            own = holds
            if held.startswith("@"):
                inner = _at_rule(held)
                own = False if holds is False or inner is False else None if inner is None else holds
                held = selectors
            elif selectors:
                own = None if holds is not False else False
            stack.append((own, held, bool(selectors), []))
            continue
        declarations.append(held)
        if mark == "}" and len(stack) > 1:
            stack.pop()
            display = _display(declarations) if selectors and holds is not False else None
            if display:
                yield selectors, holds, nested, display


class Sheet:
    """The display rules of a page's style sheets.

    Rules of one compound selector (tag, id, classes) are matched as a browser does, by
    importance, specificity and order. All others, and those that hold on some screens only,
    never hide; they show what their last compound names, if the page has every name in them.
    """

    def __init__(self, sheets: list[tuple[str, str]], names: set[str]):
        self.rules: dict[str, list] = {}
        order, hides = 0, False
        for sheet, media in sheets:
            if not re.search("display", sheet, re.I):
                continue
            for selectors, holds, nested, (important, shown) in _blocks(sheet, media):
                for _ in range(DEEPEST):
                    selectors = _OUTSIDE.sub(":some", selectors)
                for selector in selectors.split(","):
                    order += 1
                    rule = self._rule(selector.strip(), holds, shown, names)
                    if rule:
                        last, rank, certain = rule
                        rank = (math.inf, *rank) if nested else rank  # above those that it is nested in
                        self.rules.setdefault(last[0] if last else "*", []).append((frozenset(last), (important, rank, order), shown, certain))
                        hides |= not shown
        if not hides:
            self.rules = {}

    @staticmethod
    def _rule(selector: str, holds: bool | None, shown: bool, names: set[str]) -> tuple | None:
        """Names in the last compound, specificity, whether the rule is certain to hold."""
        if not selector or _NEVER.search(selector):
            return None
        certain = holds is True and bool(_COMPOUND.match(selector))
        if not (certain or shown):
            return None
        parts = [x for x in re.split(r"(?<!\\)[\s>+~]+", _PSEUDO.sub(lambda m: "", selector.replace("&", ""))) if x]
        found = [[re.sub(r"\\(.)", r"\1", x) for x in _PART.findall(p)] for p in parts]
        found = [[x if x[0] in ".#" else x.lower() for x in p] for p in found]
        every = [x for p in found for x in p]
        if not names.issuperset(every):
            return None
        pseudo = len(_PSEUDO.findall(selector))
        rank = (sum(x[0] == "#" for x in every), sum(x[0] == "." for x in every) + pseudo, sum(x[0] not in ".#" for x in every))
        last = found[-1] if found and not selector.endswith(("&", ")")) or len(found) == 1 else []
        return sorted(last, key=lambda x: (x[0] not in "#", x[0] not in ".")), rank, certain

    def hides(self, node: Node) -> tuple[bool, bool]:
        """Whether the sheets hide an element, and by a rule that its own style cannot undo."""
        names = _names(node)
        matched = [r for n in {*names, "*"} for r in self.rules.get(n, ()) if r[0].issubset(names)]
        certain = max((r for r in matched if r[3]), key=lambda r: r[1], default=None)
        if certain is None or certain[2] or any(r[2] and r[1] > certain[1] for r in matched):
            return False, False
        return True, certain[1][0]


def displayed(node: Node, sheet: Sheet) -> bool:
    """Whether a browser lays the element out at all."""
    a = node.attributes
    if node.tag in HIDDEN or "hidden" in a and a["hidden"] != "until-found":
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    own = _display(a["style"].split(";")) if "style" in a else None
    if sheet.rules:
        hides, firm = sheet.hides(node)
        if hides and not (own and own[1] and own[0] >= firm):
            return False
    return not (own and not own[1])


class Out:
    """Text being laid out: pending line ends and space, the indent, the marker of an item."""

    def __init__(self):
        self.parts: list[str] = []
        self.need, self.space, self.indent, self.marker, self.fresh = 0, False, 0, "", True

    def block(self, lines: int) -> None:
        if self.parts:
            self.need = max(self.need, lines)
        self.space = False

    def _begin(self) -> None:
        if self.need:
            self.parts.append("\n" * self.need)
        if self.need or self.fresh:
            self.parts.append(" " * (self.indent - len(self.marker)) + self.marker)
            self.marker, self.fresh = "", False
        elif self.space:
            self.parts.append(" ")
        self.need, self.space = 0, False

    def text(self, held: str) -> None:
        held = _SPACE.sub(" ", held)
        inner = held.strip(" ")
        if not inner:
            self.space |= bool(held)
            return
        self.space |= held[0] == " "
        self._begin()
        self.parts.append(inner)
        self.space = held[-1] == " "

    def exact(self, held: str) -> None:
        """Preformatted lines."""
        for i, line in enumerate(held.split("\n")):
            if i:
                self.line()
            if line:
                self._begin()
                self.parts.append(line)

    def line(self) -> None:
        """A forced line end."""
        self.need += 1
        self.space = False
        if not self.parts:
            self.need, self.fresh = 0, True

    def done(self) -> str:
        return "".join(self.parts)


@dataclass
class Table:
    """Rows of cells: (text, columns); `held` says how many more rows a cell covers a column."""

    rows: list[list[tuple[str, int]]] = field(default_factory=list)
    held: dict[int, int] = field(default_factory=dict)
    before: list[str] = field(default_factory=list)

    def cell(self, text: str, columns: int, lines: int) -> None:
        if not self.rows:
            self.rows.append([])
        row = self.rows[-1]
        at = sum(n for _, n in row)
        while self.held.get(at, 0) > 0:
            self.held[at] -= 1
            row.append(("", 1))
            at += 1
        if lines > 1:
            for c in range(at, at + columns):
                self.held[c] = lines - 1
        row.append((text, columns))

    def lines(self) -> list[str]:
        width: dict[int, int] = {}
        for row in self.rows:
            at = 0
            for text, n in row:
                if n == 1:
                    width[at] = max(width.get(at, 0), min(COLUMN, max(map(len, text.split("\n")))))
                at += n
        out = list(self.before)
        for row in self.rows:
            cells = [text.split("\n") for text, _ in row]
            for i in range(max(map(len, cells), default=0)):
                at, line = 0, []
                for held, (_, n) in zip(cells, row, strict=True):
                    size = sum(width.get(c, 0) for c in range(at, at + n)) + 3 * (n - 1)
                    line.append((held[i] if i < len(held) else "").ljust(size if n == 1 or size <= COLUMN * n else 0))
                    at += n
                out.append(" | ".join(line).rstrip())
        return out


def _number(held: str | None, least: int, most: int) -> int:
    found = re.match(r"\s*(-?\d{1,9})", held or "")
    return min(max(int(found.group(1)), least), most) if found else least


def render(root: Node, sheet: Sheet) -> str:
    """All visible text of a tree."""
    page = Out()
    outs, tables, lists = [page], [], []
    shown, exact = True, 0
    work: list = [(root, False, None)]
    while work:
        node, leaving, state = work.pop()
        out = outs[-1]
        if isinstance(node, str):
            if not shown:
                continue
            if exact:
                out.exact(node)
            else:
                out.text(node)
            continue
        tag = node.tag
        if leaving:
            shown, exact = state
            if tag in ("td", "th", "caption") and tables:
                outs.pop()
                if tag == "caption":
                    tables[-1].before += [x for x in out.done().split("\n") if x]
                else:
                    a = node.attributes
                    tables[-1].cell(out.done(), _number(a.get("colspan"), 1, MOST_COLUMNS), _number(a.get("rowspan"), 1, 65534))
            elif tag == "table":
                for line in tables.pop().lines():
                    out.block(1)
                    out.exact(line)
                out.block(2)
            elif tag in LISTS:
                lists.pop()
                out.indent -= 4 if tag == "ol" else 2
                out.block(1 if lists else 2)
            elif tag == "li":
                out.marker = ""
                out.block(1)
            elif tag == "dd":
                out.indent -= 4
                out.block(1)
            elif tag in BLOCK:
                out.block(2 if tag in SPACED else 1)
            continue
        if not displayed(node, sheet):
            continue
        if tag == "br":
            if shown:
                out.line()
            continue
        before = (shown, exact)
        if "style" in node.attributes:
            seen = _VISIBLE.search(node.attributes["style"])
            if seen:
                shown = seen.group(1).lower() == "visible"
        if tag == "table":
            out.block(2)
            tables.append(Table())
        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif tag in ("td", "th", "caption") and tables:
            outs.append(Out())
        elif tag in LISTS:
            out.block(1 if lists else 2)
            out.indent += 4 if tag == "ol" else 2
            lists.append(_number(node.attributes.get("start", "1"), -(10**9), 10**9) if tag == "ol" else None)
        elif tag == "li":
            out.block(1)
            if lists and lists[-1] is not None:
                out.marker = f"{_number(node.attributes['value'], -(10**9), 10**9) if 'value' in node.attributes else lists[-1]}. "
                lists[-1] += 1
            else:
                out.marker = "- "
        elif tag == "dd":
            out.block(1)
            out.indent += 4
        elif tag in BLOCK:
            out.block(2 if tag in SPACED else 1)
        if tag in ("pre", "textarea", "xmp"):
            exact += 1
        children = node.children
        if tag == "details" and "open" not in node.attributes:
            children = [x for x in children if isinstance(x, Node) and x.tag == "summary"][:1]
        if tag == "pre" and children and isinstance(children[0], str):
            children = [children[0].removeprefix("\r").removeprefix("\n"), *children[1:]]
        if tag not in VOID:
            work.append((node, True, before))
            work.extend((child, False, None) for child in reversed(children))
    return page.done()


def visible_text(source: str) -> str:
    """The visible text of a page."""
    return render(*build(source))


def extract_text(pages: DataFrame, keep: list[str] | None = None, source: str = "html") -> DataFrame:
    """Per page: `row` (kept columns), text, n_lines.

    A null page has null text, an empty one or one without visible text an empty text;
    n_lines counts lines with text. Every row gives one row, repeated rows too; an empty table
    gives none.
    """
    rows = rows_and_text(pages, source, keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [None if x is None else visible_text(x) for x in part.column("text").to_pylist()]
            lines = [sum(1 for x in (t or "").split("\n") if x.strip()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], ["row", "text", "n_lines"])

    return rows.mapInArrow(work, schema_with_row(rows, ("text", "string"), ("n_lines", "long")))
