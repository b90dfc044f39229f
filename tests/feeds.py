"""Small feed documents built in Python."""

import json


def approach(date="2024-01-01", epoch=1704067200000, speed="15.0", au="0.04", **other):
    item = {
        "close_approach_date": date,
        "close_approach_date_full": f"{date} 00:00",
        "epoch_date_close_approach": epoch,
        "relative_velocity": {
            "kilometers_per_second": speed,
            "kilometers_per_hour": "54000.0",
            "miles_per_hour": "33554.0",
        },
        "miss_distance": {
            "astronomical": au,
            "lunar": "15.56",
            "kilometers": "5983914.8",
            "miles": "3718231.0",
        },
        "orbiting_body": "Earth",
    }
    item.update(other)
    return item


def neo(ref="REF123", pha=True, low=1.0, high=2.0, approaches=None, **other):
    span = {"estimated_diameter_min": low, "estimated_diameter_max": high}
    item = {
        "links": {"self": f"neo/{ref}"},
        "id": ref,
        "neo_reference_id": ref,
        "name": f"({ref})",
        "nasa_jpl_url": f"sbdb/{ref}",
        "absolute_magnitude_h": 20.0,
        "estimated_diameter": {u: span for u in ("kilometers", "meters", "miles", "feet")},
        "is_potentially_hazardous_asteroid": pha,
        "close_approach_data": [approach()] if approaches is None else approaches,
        "is_sentry_object": False,
    }
    item.update(other)
    return item


def feed(days=None, **other):
    days = {"2024-01-01": [neo()]} if days is None else days
    document = {
        "links": {"next": None, "previous": None, "self": "feed"},
        "element_count": sum(len(day) for day in days.values()),
        "near_earth_objects": days,
    }
    document.update(other)
    return document


def documents(spark, *feeds):
    rows = [
        (f"f{i}.json", item if isinstance(item, str) else json.dumps(item))
        for i, item in enumerate(feeds)
    ]
    return spark.createDataFrame(rows, "source_file string, document string")
