"""Routing of free text, citations, counters and source selection on small tables."""

import pytest
from pyspark.errors import PySparkException

from tidemark.operators import citations, routing


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_best_name(spark):
    q = spark.createDataFrame([(1, "Is Ann Lee Wong leaving?"), (2, "what about lee"), (3, "Maria da Costa Silva, or Costa da Silva"), (4, ""), (5, None), (6, "AC up")], "q int, question string")
    found = routing.best_name(q, names(spark, "Ann Lee", "Ann Lee Wong", "Bo Lee", "Maria Costa Silva Reis", "Costa", "AC", "", None))
    assert {r.q: r.name for r in found.collect()} == {1: "Ann Lee Wong", 2: "Bo Lee", 3: "Costa", 6: "AC"}


def test_two_words_beat_one(spark):
    q = spark.createDataFrame([(1, "news of jose and reis")], "q int, question string")
    found = routing.best_name(q, names(spark, "Alba Jose", "Jose Maria Reis"))
    assert [r.name for r in found.collect()] == ["Jose Maria Reis"]


def test_clubs_by_place(spark):
    q = spark.createDataFrame([(1, "Porto or Ajax?"), (2, "Ajax"), (3, "nobody")], "q int, question string")
    found = {r.q: (r.club, r.other_club) for r in routing.clubs(q, names(spark, "Ajax", "Porto", "Celtic")).collect()}
    assert found == {1: ("Porto", "Ajax"), 2: ("Ajax", None)}


def test_empty_names(spark):
    q = spark.createDataFrame([(1, "Latest?")], "q int, question string")
    none = names(spark, "x").limit(0)
    assert [(r.intent, r.club) for r in routing.route(q, none, none, none, "2024-25").collect()] == [("unknown", None)]


def test_cited(spark):
    answers = spark.createDataFrame([(1,), (2,)], "q int")
    hits = spark.createDataFrame([(1, 5, "article"), (1, 6, "match_result"), (1, 7, "transfer")], "q int, doc int, doc_type string")
    got = {r.q: (r.n_citations, len(r.notes)) for r in citations.cited(answers, hits).collect()}
    assert got == {1: (3, 1), 2: (0, 4)}


def test_counters(spark):
    hits = spark.createDataFrame([("A", " p ", "", None, 1), ("A", "q", "r", "s", 3)], "club string, player string, reporter string, source string, seen_at int")
    once = citations.counted(citations.entity_rows(hits, ["seen_at"]))
    twice = citations.counters_merged(once, once)
    assert {(r.kind, r.value): (r.n, r.last_seen) for r in twice.collect()} == {("club", "A"): (4, 3), ("player", "p"): (2, 1), ("player", "q"): (2, 3), ("reporter", "r"): (2, 3), ("source", "s"): (2, 3)}


def test_unwrapped(spark):
    w = "https://news.google.com/rss/articles/"
    a = spark.createDataFrame([(w + "1", "T - Paper", "G", 0.2), (w + "2", "T", "G", 0.9), (w + "3", "T", "G", None), ("https://a.example/1", "T", "A", 0.1)], "url string, title string, source string, confidence double")
    m = spark.createDataFrame([(w + "1", "https://a.example/x"), (w + "2", w + "9"), (w + "3", " https://b.example/y "), ("https://a.example/1", "https://z.example")], "url string, decoded string")
    got = {(r.url, r.original_url, r.source, r.confidence) for r in citations.unwrapped(a, m).collect()}
    assert got == {("https://a.example/x", w + "1", "Paper", 0.68), (w + "2", None, "G", 0.9), ("https://b.example/y", w + "3", "G", 0.68), ("https://a.example/1", None, "A", 0.1)}


def test_selected_sources(spark):
    s = spark.createDataFrame([("a", ["X"]), ("b", []), ("c", ["Y"])], "key string, club_keys array<string>")
    assert sorted(r.key for r in citations.selected_sources(s, ["a", "b", "c"], "X").collect()) == ["a", "b"]
    with pytest.raises(PySparkException, match="unknown source: z"):
        citations.selected_sources(s, ["a", "z"]).collect()
