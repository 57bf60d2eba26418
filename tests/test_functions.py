"""Column functions and operators on small literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import claims as cl
from tidemark.functions import dates, scoring, text
from tidemark.operators import cases, clusters, frames, learning, matching
from tidemark.sources import sinks, tables


def one(spark, make, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(make(*(F.col(n) for n in names)).alias("x")).first().x


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://A.example/x/?utm_source=a&id=5&ref=z#top", "https://A.example/x?id=5"),
        ("https://a.example", "https://a.example/"),
        ("https://a.example/x//?b=&c=1", "https://a.example/x?c=1"),
        (" https://a.example/?page=2&refsrc=q ", "https://a.example/?page=2"),
    ],
)
def test_url(spark, url, want):
    assert one(spark, text.canonical_url, u=url) == want


def test_html(spark):
    page = "<title>T &amp; U</title><script>var x='<b>';</script><body><p>One</p> <b>two</b>&nbsp;&lt;3</body>"
    assert one(spark, text.strip_html, h=page) == "T & U One two <3"
    assert one(spark, text.page_title, h=page) == "T & U"
    assert one(spark, text.main_text, h=f"<nav>skip</nav><article>{'word ' * 80}</article>").startswith("word word")


def test_headlines(spark):
    assert one(spark, text.headline, t="A - B story - The Paper") == "A - B story"
    assert one(spark, text.publisher_suffix, t="A - B story - The Paper") == "The Paper"
    assert one(spark, text.fingerprint, t="The latest: Star signs for Club! - Paper") == "club"
    assert one(spark, text.fingerprint, t="The Deal") == "the deal"
    assert one(spark, lambda s, t: text.publisher(s, t), s="Google News EN", t="X - Daily") == "Daily"


def test_names(spark):
    assert one(spark, text.alnum_folded, n="  Éric  O'Neil-Ñoño ") == "eric o neil nono"
    assert one(spark, text.alnum_unicode, n="Éric O'Neil") == "éric o neil"
    assert one(spark, text.surname, n="Eric O'Neil") == "neil"
    assert one(spark, text.jaccard, a="Ann Lee Wu", b="Lee Wu") == pytest.approx(2 / 3)
    assert one(spark, text.parse_list, x='["a", "b c"]') == ["a", "b c"] and one(spark, text.parse_list, x="a| b") == ["a", "b"] and one(spark, text.parse_list, x="") == []
    assert one(spark, text.reporter, j="", s="Paper / Ann Lee") == "Ann Lee"
    assert one(spark, text.trigrams, x="Ab") == ["  a", " ab", "ab ", "b  "]


def test_timestamps(spark):
    want = dt.datetime(2024, 3, 5, 14, 30)
    for raw in ("2024-03-05T14:30:00Z", "2024-03-05 14:30:00", "Tue, 05 Mar 2024 14:30:00 GMT", "20240305T143000Z", "20240305143000", "2024-03-05T15:30:00+01:00"):
        assert one(spark, dates.parse_timestamp, r=raw) == want, raw
    assert one(spark, dates.parse_timestamp, r="soon") is None
    assert one(spark, dates.football_date, r="05/03/24") == dt.date(2024, 3, 5)


def test_seasons(spark):
    assert one(spark, lambda d: dates.season(d.cast("date")), d="2024-06-30") == "2023-24"
    assert one(spark, lambda d: dates.season(d.cast("date")), d="1999-07-01") == "1999-00"
    assert one(spark, dates.season_start, s="2023-24") == 2023 and one(spark, dates.season_start, s="x") == 0
    assert one(spark, lambda b, d: dates.age_on(b.cast("date"), d.cast("date")), b="2000-05-10", d="2024-05-09") == 23
    assert one(spark, dates.window_proxy, s="2023-24", w="Winter") == dt.date(2024, 1, 1)


def test_claim_text(spark):
    norm = lambda f: lambda t: f(text.alnum_folded(t))
    assert one(spark, norm(cl.stage), t="Club confirm agreement to sign Pat") == "official"
    assert one(spark, norm(cl.stage), t="Pat interested in chess") == "unclear"
    assert one(spark, norm(cl.transfer_type), t="loan with option agreed") == "loan_with_option"
    way = lambda t, c, p: cl.direction(text.alnum_folded(t), c, p)
    assert one(spark, way, t="Redtown sign Pat Holm from Bluetown", c="Redtown", p="Pat Holm") == "in"
    assert one(spark, way, t="Redtown's Holm to leave", c="Redtown", p="Pat Holm") == "out"
    fees = one(spark, lambda t: F.struct(*(c.alias(n) for c, n in zip(cl.fee_and_wage(t), ("f", "w")))), t="a £10m fee, €12.5 million in all, $100k a week")
    assert fees.f == pytest.approx(12.5e6) and fees.w == pytest.approx(100e3 * 0.92 * 52)
    # A unit is read as one letter where it can be, which ends the amount: this is no weekly wage.
    odd = one(spark, lambda t: cl.money(t), t="paid £1.5 million a week and £2m a week")
    assert [(r.raw, r.weekly, round(r.eur)) for r in odd] == [("£1.5 m", False, 1755000), ("£2m a week", True, 2340000)]
    assert one(spark, way, t="Bluetown close in on deal for Pat Holm", c="Redtown", p="") == "out"
    assert one(spark, way, t="Redtown bid for Holm", c="", p="Pat Holm") == "unclear"


def test_mentions(spark):
    texts = spark.createDataFrame([(1, "Redtown want Ána Holm-Bergh now"), (2, "Bergh again"), (3, "nobody")], "id bigint, text string")
    names = spark.createDataFrame([("Ana Holm Bergh",), ("Li Wu",)], "name string")
    assert sorted(map(tuple, cl.mentions(texts, names).collect())) == [(1, "Ana Holm Bergh"), (2, "Ana Holm Bergh")]
    assert cl.best_player(cl.mentions(texts, names)).count() == 2


def test_quality(spark):
    q = lambda d, m, f, w, a: scoring.transfer_quality(d, m, f, w, a)
    assert one(spark, q, d="in", m=10e6, f=5e6, w=0.0, a=24.0) == pytest.approx(0.45 * 0.75 + 0.30 + 0.25)
    assert one(spark, q, d="out", m=0.0, f=5e6, w=50e6, a=0.0) == pytest.approx(0.45 * 0.5 + 0.30 * 0.65 + 0.25 * 0.65)


def bars(spark, closes, ticker="T"):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame([(ticker, day + dt.timedelta(i), float(c), 10) for i, c in enumerate(closes)], "ticker string, date date, close double, volume bigint")


def test_as_of(spark):
    b = bars(spark, range(1, 6)).where("day(date) <> 3").withColumn("idx", F.row_number().over(frames.Window.partitionBy("ticker").orderBy("date")) - 1)
    e = spark.createDataFrame([(i, "T", dt.date(2024, 1, i)) for i in range(1, 8)], "event_id int, ticker string, event_date date")
    get = lambda **k: {r.event_id: r.idx for r in frames.as_of(e, b, **k).collect()}
    assert get() == {1: 0, 2: 1, 3: 2, 4: 2, 5: 3, 6: None, 7: None}
    assert get(strict=True) == {1: 1, 2: 2, 3: 2, 4: 3, 5: None, 6: None, 7: None}
    assert get(forward=False) == {1: None, 2: 0, 3: 1, 4: 1, 5: 2, 6: 3, 7: 3}


def test_returns_skip_days_without_price(spark):
    got = [r.ret for r in frames.simple_returns(bars(spark, [0, 10, 11])).orderBy("date").collect()]
    assert got == [pytest.approx(0.1)]


def test_gap_clusters(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, "C", "P", t + dt.timedelta(days=d), s) for i, (d, s) in enumerate([(0, "direct"), (5, "none"), (10.99, "none"), (16.99, "none"), (30, "direct")])]
    df = spark.createDataFrame(rows, "claim_id int, club string, player string, published_at timestamp, prediction_scope string")
    got = {r.claim_id: r.cluster_no for r in clusters.gap_clusters(df).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 4: 3}  # the third cluster has no direct row; six full days part


def test_loan_pairs(spark):
    rows = [("a", 1, dt.date(2023, 1, 1), 1, 2, 0.0), ("b", 1, dt.date(2023, 6, 1), 2, 1, None), ("c", 1, dt.date(2023, 7, 1), 1, 3, 5.0), ("d", 1, dt.date(2025, 1, 1), 1, 2, 0.0)]
    df = spark.createDataFrame(rows, "move_id string, player_id int, date date, from_id int, to_id int, fee double")
    assert {r.move_id: r.kind for r in matching.loan_kinds(df).collect()} == {"a": "loan", "b": "loan_return", "c": "permanent", "d": "permanent"}


def test_match_needs_a_player(spark):
    claims = spark.createDataFrame([("c1", "Pat Holm", "R", "2023-24", dt.date(2023, 8, 1), "in", "permanent", 5e6), ("c2", "Xu Li", "R", "2023-24", dt.date(2023, 8, 1), "in", "permanent", 5e6), ("c3", "Pat Holm", "Q", "2023-24", dt.date(2023, 8, 1), "in", "permanent", 5e6)], "claim_id string, player string, club string, season string, published date, direction string, kind string, fee double")
    moves = spark.createDataFrame([("m1", "Pat Holm", "R", "2023-24", dt.date(2023, 8, 3), "in", "permanent", False, 5e6), ("m2", "P Holm", "R", "2023-24", dt.date(2023, 8, 3), "in", "permanent", False, 5e6)], "move_id string, m_player string, club string, season string, m_date date, m_direction string, m_kind string, m_loan boolean, m_fee double")
    got = {r.claim_id: r for r in matching.best_matches(claims, moves).collect()}
    assert got["c1"].move_id == "m1" and got["c1"].ambiguous == 0 and got["c1"].candidates == 2 and got["c1"].score == pytest.approx(1.06)
    assert got["c2"].status == "missing_player_signal" and got["c3"].status == "no_candidates"


def test_nearest(spark):
    left = spark.createDataFrame([(1, "k", dt.date(2024, 1, 10)), (2, "z", dt.date(2024, 1, 10))], "id int, k string, d date")
    right = spark.createDataFrame([("k", dt.date(2024, 1, 8), 7), ("k", dt.date(2024, 1, 12), 5), ("k", dt.date(2024, 2, 1), 1)], "k string, e date, t int")
    got = {r.id: r.t for r in matching.nearest(left, right, "k", "d", "e", ["t"]).collect()}
    assert got == {1: 5, 2: None}


def test_similar_cases_narrow_their_pool(spark):
    fields = "case_id int, club string, direction string, target_role string, position string, credibility_score double, transfer_indicator double, rumor_stage_score double, stock_context_indicator double, age double, market_value_eur double"
    row = lambda i, club, way, role: (i, club, way, role, "p", 0.5, 0.5, 0.5, 0.5, 25.0, 1e6)
    now = spark.createDataFrame([row(0, "A", "in", "buyer"), row(9, "A", "out", "seller")], fields)
    past = spark.createDataFrame([row(1, "A", "in", "buyer"), row(2, "B", "in", "buyer"), row(3, "A", "out", "buyer"), row(4, "A", "out", "seller")], fields)
    got = sorted((r.q_case_id, r["rank"], r.case_id) for r in cases.similar_cases(now, past, 2).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (9, 1, 4), (9, 2, 3)]


def test_split_guards(spark):
    df = spark.createDataFrame([("direct", 2020, "positive"), ("direct", 2030, "neutral"), ("none", 2020, "neutral"), ("direct", 2030, ""), ("direct", 2020, None)], "prediction_scope string, season_start int, label string")
    assert [r.split for r in learning.split_of(df, 2024).collect()] == ["train", "test", "intelligence_only", "live_unlabeled", "unlabeled"]


def test_upsert_and_fields(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, loaded_at bigint")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "id int, v string, loaded_at bigint")
    assert {r.id: r.v for r in sinks.last_write_wins(old, new, ["id"]).collect()} == {1: "a", 2: "c", 3: "d"}
    df = spark.createDataFrame([(["x", "y"], 1)], "tags array<string>, n int")
    assert sinks.to_fields(df, ["n", "tags", "gone"]).first().asDict() == {"n": 1, "tags": "x|y", "gone": None}


def test_landed_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("date,club,player,direction,from_club,to_club,age,position,market_value_eur,transfer_fee_eur,wage_eur_annual,source,source_url,season,transfer_type,is_loan\n2023-08-01,R,P,in,Q,R,24,CB,1,,,s,u,,,\n2023-08-01,R,P,sideways,Q,R,,,,,,,,,,\n")
    good, bad = tables.read_transfers(spark, str(tmp_path / "t.csv"))
    assert good.first().season == "2023-24" and good.first().transfer_type == "permanent" and bad.count() == 1
    (tmp_path / "c.json").write_text('{"ticker":"T","timestamp":[86400,172800],"open":[null,2.0],"high":[1.5,2.0],"low":[1.0,2.0],"close":[1.2,null],"volume":[5,6]}')
    assert [(r.open, r.close, str(r.date)) for r in tables.read_chart(spark, str(tmp_path / "c.json")).collect()] == [(1.2, 1.2, "1970-01-02")]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>u1</link><pubDate>Tue, 05 Mar 2024 14:30:00 GMT</pubDate><description>d</description></item><item><title>B</title><guid>u2</guid><published>2024-03-06T00:00:00Z</published><summary>e</summary></item></channel></rss>")
    assert sorted((r.title, r.url, r.snippet, str(r.published_at)) for r in tables.read_feed(spark, str(tmp_path / "f.xml")).collect()) == [("A", "u1", "d", "2024-03-05 14:30:00"), ("B", "u2", "e", "2024-03-06 00:00:00")]
    assert [r.title for r in tables.read_feed(spark, str(tmp_path / "f.xml"), per_source=1).collect()] == ["B"]
    rows = spark.createDataFrame([("05/03/24", "Red Town", "Blue", "2", "1")], "Date string, HomeTeam string, AwayTeam string, FTHG string, FTAG string")
    known = spark.createDataFrame([("red town", "Redtown FC")], "alias_norm string, club string")
    got = tables.league_results(rows, known).first()
    assert (got.club, got.opponent, got.result, got.score, got.venue) == ("Redtown FC", "Blue", "W", "2-1", "home")


def test_stream_upsert(spark, tmp_path):
    from tidemark.streaming import jobs
    from tidemark.streaming.keyed_table import KeyedTable, upsert_batches

    table = KeyedTable(spark, str(tmp_path / "s"), "id int, v string", ["id"], [])
    write = upsert_batches(table)
    for n, rows in enumerate([[(1, "a"), (2, "b")], [(2, "c")], [(2, "c")]]):
        write(spark.createDataFrame(rows, "id int, v string"), n)
    assert {r.id: r.v for r in table.read().collect()} == {1: "a", 2: "c"}
    quiet, undated = jobs.dated(spark.createDataFrame([(1, None), (2, dt.datetime(2024, 1, 1))], "id int, published_at timestamp"))
    assert quiet.first().id == 2 and undated.first().id == 1


def test_named_clubs_normalise_the_text_once(spark):
    rows = spark.createDataFrame([("Ajax  and Real\tMadrid meet", 1), ("RM win", 2), ("", 3), (None, 4)], "t string, i int")
    clubs = F.array(*(F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, a)).cast("array<string>").alias("aliases")) for n, a in (("Real  Madrid", ["RM", " "]), ("Ajax", []), ("", []))))
    one_row = rows.join(F.broadcast(spark.range(1).select(text.club_labels(clubs).alias("c"))))
    want = [["Real  Madrid", "Ajax"], ["Real  Madrid"], [], []]
    for found in (rows.select("i", text.named_clubs(F.col("t"), clubs).alias("n")), one_row.select("i", text.named_clubs(F.col("t"), F.col("c"), labelled=True).alias("n"))):
        assert [r.n for r in found.orderBy("i").collect()] == want
        assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(coalesce(t") == 1
