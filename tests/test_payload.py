"""Nested payloads: round trips, parts, key order, odd lines; the grounding audit by hand."""

import datetime as dt
import json
from pathlib import Path

from pyspark.sql import functions as F

from tidemark.operators import grounding, payload

SCHEMA = "season string, club string, player string, case_id bigint, day date, label string, score double"


def test_round_trip(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    rows = [(f"202{i % 3}-x", f"Club {i % 4}", f"p {i % 7}", i, day + dt.timedelta(days=i % 50), ("up", "down")[i % 2], i / 8) for i in range(400)]
    rows += [("2020-x", "Hot", "one", 1000 + i, None, None, None) for i in range(300)] + [("2020-x", None, None, 5000, day, "up", 1.0)]
    docs = payload.documents(spark.createDataFrame(rows, SCHEMA), ("up", "down"), part=40).cache()
    sizes = [sum(map(len, json.loads(r.value)["players"].values())) for r in docs.collect()]
    assert max(sizes) < 100 and sum(sizes) == 701
    one = docs.where("club = 'Club 1' and part = 0").first().value
    pairs = json.loads(one, object_pairs_hook=lambda x: [k for k, _ in x] and x)
    assert [k for k, _ in pairs] == ["club", "part", "players", "season", "stats"]
    players = [k for k, _ in dict(pairs)["players"]]
    assert players == sorted(players)
    payload.write(docs, str(tmp_path / "p"))
    # Lines of another shape, and lines that are none, don't end the job.
    (tmp_path / "p/season=2020-x/odd.txt").write_text('{"club": "Odd", "players": 7}\n{not json\n[1]\n')
    back = payload.read(spark, str(tmp_path / "p"))
    got = payload.signals(back).where("case_id is not null")
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    want = [(s, c, p or "", *rest) for s, c, p, *rest in rows]
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
    stats = payload.fields(back, {"club": ("$.club", "string"), "n": ("$.stats.signals", "bigint"), "up": ("$.stats.by_label.up", "int")}, keep=("season",)).distinct()
    found = {tuple(r) for r in stats.collect()}
    assert {("2020-x", "Hot", 300, 0), ("2020-x", "Odd", None, None), ("2020-x", None, 1, 1)} <= found
    assert sum(n or 0 for _, _, n, _ in found) == 701
    assert not list(Path(tmp_path / "p").glob("*.parquet"))


def test_payload_of_nothing(spark):
    assert payload.documents(spark.createDataFrame([], SCHEMA), ("up",)).collect() == []


def test_grounding_by_hand(spark):
    day = dt.date(2024, 1, 1)
    answers = spark.createDataFrame([(1, "Redtown agreed terms with Holm", 1, 1), (2, "", 0, 0), (3, "words alone", 0, 1)], "run int, text string, warnings int, notes int")
    citations = spark.createDataFrame([(1, "Redtown: Holm agreed", "a", day, 0.9), (1, "terms", "b", None, 0.7), (3, "else", " ", None, None)], "run int, text string, source string, day date, strength double")
    searches = spark.createDataFrame([(1, f"p{i}", m, 4) for i, m in enumerate(["x", "y", "z", "x", "y"])] + [(3, "p", "x", 0)], "run int, purpose string, method string, hits int")
    got = {r.run: r for r in grounding.audit(answers, citations, searches, F.lit(dt.date(2024, 1, 11))).collect()}
    one = got[1]
    assert (one.answer_support, one.citation_strength, one.source_diversity, one.retrieval_health, one.citation_freshness, one.uncertainty_disclosure) == (1.0, 0.8, 1.0, 1.0, 1.0, 1.0)
    assert (one.overall, one.status, one.warnings, one.advice) == (0.964, "strong", [], ["usable"])
    assert (got[2].answer_support, got[2].citation_freshness, got[2].overall) == (0.0, 0.45, 0.054)
    three = got[3]
    assert (three.source_diversity, three.retrieval_health, three.uncertainty_disclosure) == (0.0, 0.1867, 0.55)
    assert "searches without evidence" in three.warnings and three.advice == ["improve_grounding", "more_sources", "rebuild_index", "refresh_articles"]
