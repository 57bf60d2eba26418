"""Packing: what fits one range is placed in one last sweep."""

from __future__ import annotations

from collections import Counter

import pytest

from tidemark.llm import packing


@pytest.mark.parametrize("range_rows, most", [(3000, 1), (700, 12)])
def test_last_sweep(spark, monkeypatch, range_rows, most):
    calls = []
    real = packing.written
    monkeypatch.setattr(packing, "written", lambda df, name, **o: calls.append(name) or real(df, name, **o))
    sizes = {i: 1 + i * 7919 % 199 for i in range(2000)}
    got = packing.rounds(spark.createDataFrame(list(sizes.items()), "id bigint, size bigint"), 200, salts=8, range_rows=range_rows).collect()
    assert sorted(r.id for r in got) == sorted(sizes)
    filled = Counter()
    for r in got:
        filled[r.sequence] += sizes[r.id]
    assert max(filled.values()) <= 200
    assert len(filled) <= sum(sizes.values()) / 200 * 1.02 + 1
    assert len(calls) <= most
