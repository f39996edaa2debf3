"""Payloads of several schema versions, and latency sketches."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from hydrolattice.sources import weather_payloads
from hydrolattice.streaming import sketches


def test_drifting_payloads_lose_only_what_cannot_be_read(spark):
    good = {"daily": {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_max": [30.5, None], "windspeed_10m_max": ["4.0", "x"], "rain_sum": [1.0], "new_field": [1, 2]}, "units": {}}
    rows = [(1, json.dumps(good)), (2, "{not json"), (3, None), (4, "[]"), (5, json.dumps({"daily": {"temperature_2m_max": [1.0]}})), (6, json.dumps({"daily": {"time": ["2024-01-01", "no day"], "rain_sum": 7}}))]
    texts = spark.createDataFrame(rows, "id long, value string")
    found = {(r["id"], r["date"]): r for r in weather_payloads.flatten_drifting(texts, keys=["id"]).collect()}
    assert sorted(found) == [(1, date(2024, 1, 1)), (1, date(2024, 1, 2)), (6, date(2024, 1, 1))]
    first, second = found[1, date(2024, 1, 1)], found[1, date(2024, 1, 2)]
    assert (first["temp_max_c"], first["wind_speed_mps"], first["rain_mm"], first["et0_mm"]) == (30.5, 4.0, 1.0, None)
    assert (second["temp_max_c"], second["wind_speed_mps"], second["rain_mm"]) == (None, None, None)
    problems = {(r["id"], r["field"], r["problem"]): r["values"] for r in weather_payloads.payload_problems(texts, keys=["id"]).collect()}
    assert problems[1, "new_field", "unknown"] == 1 and problems[1, "wind_speed_10m_max", "mistyped"] == 1 and (1, "temperature_2m_max", "mistyped") not in problems
    assert all(problems[i, None, "unreadable"] == 1 for i in (2, 3, 4))
    assert problems[5, "time", "missing"] == 1 and problems[6, "time", "mistyped"] == 1 and problems[6, "rain_sum", "mistyped"] == 1
    assert weather_payloads.flatten_drifting(texts.limit(0), keys=["id"]).count() == 0


def test_merged_sketches_stay_in_their_bound(spark):
    rng = np.random.default_rng(3)
    start, values = datetime(2024, 1, 1), rng.gamma(2, 60, 40_000)
    rows = spark.createDataFrame([(start + timedelta(seconds=i * 3600 / 40_000), "/a", float(v)) for i, v in enumerate(values)] + [(start, "/a", None), (start, None, 5.0)], "ts timestamp, route string, ms double")
    five = sketches.latency_sketches(rows, ["route"], "ms")
    assert five.count() == 13
    hour = {r["route"]: r for r in sketches.merged(five, ["route"], "1 hour").select("route", "window_start", sketches.sketch_rows().alias("n"), *[sketches.sketch_quantile(q).alias(f"q{int(q * 100)}") for q in (0.5, 0.95, 0.99)], F.length("sketch").alias("bytes")).collect()}
    assert hour["/a"]["n"] == 40_000 and hour["/a"]["window_start"] == start and hour["/a"]["bytes"] < 40_000
    for q in (50, 95, 99):
        assert abs((values <= hour["/a"][f"q{q}"]).mean() - q / 100) <= 2 * sketches.rank_error()
    assert hour[None]["q95"] == 5.0
    whole = sketches.merged(sketches.merged(five, ["route"], "15 minutes"), [], "1 day")
    assert whole.select(sketches.sketch_rows().alias("n")).first()["n"] == 40_001
