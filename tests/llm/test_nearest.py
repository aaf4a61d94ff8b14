"""Tick expansion against brute force."""

import datetime as dt
import random

import pytest

from chronopanel.llm import nearest


@pytest.mark.parametrize("width", [1, 7, 128])
def test_ticks_equal_brute_force(spark, width):
    rng = random.Random(width)
    day = lambda n: dt.date(2010, 1, 1) + dt.timedelta(days=n)
    left = [(rng.choice("abc"), i, day(rng.randint(0, 400))) for i in range(60)] + [(None, 99, day(1)), ("a", 100, None)]
    right = [(rng.choice("abc"), day(rng.randint(0, 400)), f"p{i:03}") for i in range(40)] * 2 + [(None, day(1), "x"), ("a", None, "y"), ("b", day(3), None)]
    got = nearest.nearest_by_ticks(spark.createDataFrame(left, "e string, i int, d date"), spark.createDataFrame(right, "e string, rd date, p string"), "e", "d", "rd", "p", 20, width)
    want = set()
    for e, i, d in left:
        near = [(-abs((d - r).days), p) for x, r, p in right if e and d and x == e and r and p and abs((d - r).days) <= 20]
        if near:
            want.add((i, max(near)[1], -max(near)[0]))
    assert {(r["i"], r["p"], r["distance"]) for r in got.collect()} == want


def test_ticks_on_empty_tables(spark):
    left, right = spark.createDataFrame([], "e string, d date, extra int"), spark.createDataFrame([], "e string, rd date, p string, extra int")
    assert nearest.nearest_by_ticks(left, right, "e", "d", "rd", "p", 20).count() == 0


def test_captures_match_their_observations(spark):
    shots = spark.createDataFrame([("1", "event", dt.date(2015, 7, 1), False, "x"), ("1", "event", dt.date(2015, 7, 1), False, "y"), ("1", "post", dt.date(2030, 7, 1), True, "x"), ("2", "event", None, False, "x"), ("3", "event", dt.date(2015, 7, 1), False, "x")],
        "firm_id string, relative_timepoint string, target_date date, observation_is_future boolean, timestamp string")
    row = lambda f, t, c="200", m="text/html": (f, t, c, m, "clash")
    caps = spark.createDataFrame([row("1", "20150621000000"), row("1", "20150711000000"), row("1", "20150711000000"), row("1", "20150701000000", "404"), row("1", "20150701000000", "200", None), row("1", "20150701"), row("1", None), row("2", "20150701000000"), row("3", "20161231000000")],
        "firm_id string, timestamp string, statuscode string, mimetype string, target_date string")
    assert {tuple(r) for r in nearest.found(shots, caps).collect()} == {("1", "event", "20150711000000")}
