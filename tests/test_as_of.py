"""As-of lookups beside brute force; events are not gathered by ticker."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tidemark.operators import frames

DAY = dt.date(2024, 1, 1)


@pytest.mark.parametrize("forward, strict", [(True, False), (True, True), (False, False)])
def test_as_of(spark, forward, strict):
    rnd = random.Random(3)
    bars = [(t, DAY + dt.timedelta(d), i) for t in "AB" for i, d in enumerate(sorted(rnd.sample(range(5, 60), 20)))]
    events = [(n, rnd.choice("ABC"), DAY + dt.timedelta(rnd.randint(0, 70))) for n in range(300)] + [(300, "A", None), (301, None, DAY)]
    fits = lambda b, e: b < e if not forward else b > e if strict else b >= e
    want = {}
    for n, ticker, day in events:
        near = [(d, i) for t, d, i in bars if day and t == ticker and fits(d, day)]
        want[n] = (min(near) if forward else max(near))[1] if near else None
    found = frames.as_of(spark.createDataFrame(events, "n int, ticker string, event_date date"), spark.createDataFrame(bars, "ticker string, date date, idx int"), forward, strict)
    assert found.columns == ["n", "ticker", "event_date", "idx"]
    assert {r.n: r.idx for r in found.collect()} == want
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
