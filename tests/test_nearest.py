"""Nearest in time, nearest points, medians, candidate blocks and boosting against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cases, matching, neighbours, rollups
from tidemark.operators.boosting import SoftmaxBoosting
from tidemark.operators.quantiles import exact_median

DAY = dt.date(2024, 1, 1)


def links_by_hand(signals, moves, k):
    out = []
    for i, player, club, role, day in signals:
        scored = []
        for m, name, m_club, m_role, m_day in moves:
            if player is None or name is None or player.strip().lower() != name.strip().lower():
                continue
            near = max(0.0, 0.17 - min(abs((m_day - day).days), 365) / 365.0 * 0.17) if day and m_day else 0.0
            score = round((0.55 if club is not None and club == m_club else 0) + (0.20 if role is not None and role == m_role else 0) + near, 6)
            if score > 0:
                scored.append((-score, -(m_day or dt.date(1, 1, 1)).toordinal(), m))
        out += [(i, m, -s, r) for r, (s, _, m) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_links_by_hand(spark):
    rnd = random.Random(1)
    one = lambda *xs: rnd.choice(xs)
    day = lambda: one(None, *(DAY + dt.timedelta(days=rnd.randrange(-900, 900)) for _ in range(12)))
    moves = [(f"m{i:03}", one("Pat", " pat", "Kim", None), one("A", "B", None), one("buyer", "seller"), day()) for i in range(150)]
    moves += [(f"n{i:03}", "Pat", "A", "buyer", DAY) for i in range(9)]
    signals = [(i, one("PAT", "Kim ", "Nobody", None), one("A", "C", None), one("buyer", "none", None), day()) for i in range(80)] + [(99, "Pat", "A", "buyer", DAY), (98, "Pat", "Z", "z", DAY)]
    s = spark.createDataFrame(signals, "signal_id int, player string, club string, role string, day date")
    m = spark.createDataFrame(moves, "move_id string, player string, m_club string, m_role string, m_day date")
    assert sorted(tuple(r) for r in cases.confirmed_links(s, m).collect()) == links_by_hand(signals, moves, 3)
    assert cases.confirmed_links(s, m.limit(0)).count() == cases.confirmed_links(s.limit(0), m).count() == 0


def test_a_player_with_very_many_moves(spark):
    """10^5 moves and 10^4 signals of one player: 10^9 pairs, which are never made."""
    m = spark.range(100_000).select(F.col("id").cast("string").alias("move_id"), F.lit("Pat").alias("player"), F.concat(F.lit("C"), F.col("id") % 50).alias("m_club"), F.lit("buyer").alias("m_role"), F.expr("date_add(date'2000-01-01', cast(id % 9000 as int))").alias("m_day"))
    s = spark.range(10_000).select(F.col("id").alias("signal_id"), F.lit("pat").alias("player"), F.concat(F.lit("C"), F.col("id") % 70).alias("club"), F.lit("buyer").alias("role"), F.expr("date_add(date'2001-01-01', cast(id % 5000 as int))").alias("day"))
    got = cases.confirmed_links(s, m)
    assert got.count() == 30_000
    row = got.where("signal_id = 10 and rank = 1").first()
    assert row.score > 0.9
    w = s.select(F.lit("X").alias("club"), "player", "day").distinct()
    moves = m.select(F.lit("pat").alias("player"), F.col("move_id").alias("deal_id"), F.lit(1).alias("line"), F.col("m_day").alias("date"), F.lit(1.0).alias("market_value_eur"))
    assert rollups.with_best_link(w.where("day = date'2001-01-01'"), moves).first().score == 0.72


def points(rnd, n, first):
    rows = []
    for i in range(n):
        c = rnd.choice([0.0, 5.0, 9.0])
        rows.append((first + i, [c + rnd.gauss(0, 0.3) for _ in range(6)] if i % 9 else [1.0] * 6, rnd.choice(["a", "b", None]), rnd.choice("xy")))
    return rows


@pytest.mark.parametrize("part, chunk, block", [(16_384, 64, 20_000), (50, 8, 7)])
def test_nearest_points(spark, monkeypatch, part, chunk, block):
    rnd = random.Random(part)
    monkeypatch.setattr(neighbours, "PART_ROWS", part)
    train, asked = points(rnd, 400, 0), points(rnd, 30, 1000)
    schema = "id bigint, x array<double>, g string, h string"
    got, effort = neighbours.nearest(spark.createDataFrame(train, schema).repartition(3), spark.createDataFrame(asked, schema), "x", ["g", "h"], "id", 5, block=block)
    x = np.array([r[1] for r in train])
    w = x.max(axis=0) - x.min(axis=0)
    want = []
    for q, v, *cats in asked:
        d = [(round(float(np.sqrt((((np.array(v) - np.array(r[1])) / w) ** 2).sum() + sum(a is None or a != b for a, b in zip(cats, r[2:])))), 6), r[0]) for r in train]
        want += [(q, i, s) for i, (s, _) in enumerate(sorted(d)[:5], 1)]
    rows = got.orderBy("q", "rank").collect()
    assert [(r.q, r["rank"]) for r in rows] == [w[:2] for w in want] and [r.distance for r in rows] == pytest.approx([w[2] for w in want], abs=2e-6)
    e = effort.first()
    assert e.pairs == 400 * 30 and e.computed <= e.pairs
    assert neighbours.nearest(spark.createDataFrame(train, schema), spark.createDataFrame([], schema), "x", ["g", "h"], "id", 5)[0].count() == 0


def test_pivots_prune(spark):
    """On clusters most distances are never computed."""
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(30, 8)) * 10
    x = centres[rnd.integers(0, 30, 6000)] + rnd.normal(size=(6000, 8)) * 0.2
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>").coalesce(1)
    got, effort = neighbours.nearest(rows, rows.where("id < 60"), "x", [], "id", 4)
    assert got.count() == 240
    e = effort.first()
    assert e.computed < e.pairs / 3


@pytest.mark.parametrize("few, ranges", [(50_000, 1024), (3, 4), (1, 2)])
def test_exact_median(spark, few, ranges):
    rnd = random.Random(few)
    rows = [("a", rnd.gauss(0, 1)) for _ in range(101)] + [("b", rnd.expovariate(0.001)) for _ in range(100)] + [("c", 2.5)] * 40 + [("c", 3.0)] + [("d", 1.0), ("d", 2.0), ("e", -7.0), (None, 4.0), ("f", None), ("g", float("nan")), ("h", 1e300), ("h", -1e300), ("h", 0.0)]
    got = {r.k: r.median for r in exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", few, ranges).collect()}
    by = {}
    for k, v in rows:
        if v is not None and v == v:
            by.setdefault(k, []).append(v)
    assert got == {k: pytest.approx(float(np.median(v)), rel=1e-12) for k, v in by.items()}


def test_boosting_learns_three_classes(spark):
    from pyspark.ml.functions import array_to_vector

    rnd = random.Random(9)
    rows = [(i, [rnd.random(), rnd.random()], 1.0) for i in range(400)]
    rows = [(i, x, float(0 if x[0] < 0.3 else 1 if x[1] < 0.5 else 2), w) for i, x, w in rows]
    df = spark.createDataFrame(rows, "id int, x array<double>, _y double, _w double").withColumn("scaled", array_to_vector("x"))
    model = SoftmaxBoosting(3, rounds=6, depth=3, step=0.6).fit(df.where("id % 4 <> 0"))
    out = model.transform(df.where("id % 4 = 0")).select("_y", "prediction", "probability").collect()
    assert sum(r._y == r.prediction for r in out) >= 0.9 * len(out)
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in out)


def matches_by_hand(claims, moves):
    words = lambda x: [w for w in "".join(c if c.isalnum() else " " for c in (x or "").lower()).split()]
    out = {}
    for cid, player, club, clubs, season, related, day, way, kind, fee in claims:
        club, season = (club or "").strip() or None, (season or "").strip() or None
        if not related:
            out[cid] = ("not_transfer_related", None, 0)
            continue
        names = {club, *[c for c in clubs or [] if c]} - {None}
        pool = [m for m in moves if m[2] in names and (season is None or m[3] == season)]
        if not pool and club is None:
            pool = moves
        if not pool:
            out[cid] = ("no_candidates", None, 0)
            continue
        scored = []
        for mid, name, m_club, m_season, m_day, m_way, m_kind, loan, m_fee in pool:
            a, b = words(player), words(name)
            sa, sb = set(a), set(b)
            signal = 0.45 if a and a == b else 0.25 if a and b and a[-1] == b[-1] and len(a[-1]) >= 4 else 0.15 if sa & sb and len(sa & sb) / len(sa | sb) >= 0.5 else 0
            s = signal + (0.2 if club and club == m_club else 0.1 if club and " ".join(words(club)) in " ".join(words(m_club)) else 0) + (0.1 if season and season == m_season else 0)
            gap = abs((m_day - day).days)
            s += 0.1 * next((v for d, v in ((7, 1), (30, 0.8), (90, 0.5), (180, 0.2)) if gap <= d), 0)
            s += (0.08 if way == m_way else -0.12) if way in ("in", "out") else 0
            s += 0 if kind == "unclear" else 0.05 if kind == m_kind else 0.03 if kind == "loan" and loan else -0.05
            f = 1 - abs(fee - m_fee) / max(fee, m_fee) if fee and m_fee and fee > 0 and m_fee > 0 else 0
            s += 0.08 if f >= 0.8 else 0.04 if f >= 0.5 else 0
            scored.append((-round(s, 6), mid, signal))
        scored.sort()
        status = "missing_player_signal" if not scored[0][2] else "score_below_threshold" if -scored[0][0] < 0.45 else "matched"
        close = len(scored) > 1 and round(scored[1][0] - scored[0][0], 6) < 0.07
        out[cid] = (status, scored[0][1] if status == "matched" else None, int(status == "matched" and close))
    return out


@pytest.fixture(scope="module")
def told():
    rnd = random.Random(12)
    one = lambda *xs: rnd.choice(xs)
    first, last = ["Pat", "Kim", "Li", "Jo"], ["Surname", "Poe", "Old Man", "Li", "Bergström", ""]
    name = lambda: f"{one(*first)} {one(*last)}".strip() if rnd.random() < 0.9 else one("", None, "Poe", "Jo Kim Li Pat")
    clubs = ["Red", "Red Town", "Blue", "Green"]
    day = lambda: DAY + dt.timedelta(days=rnd.randrange(400))
    fee = lambda: one(None, 0.0, 1e6, 1.1e6, 5e6, 9e6)
    moves = [(f"m{i:03}", name(), one(*clubs), one("2023-24", "2024-25"), day(), one("in", "out"), one("loan", "permanent"), rnd.random() < 0.4, fee()) for i in range(160)]
    claims = [(i, name(), one(*clubs, "", None, "Nowhere"), one([], None, ["Blue"], ["Green", "Red", "Green"], ["Nowhere"]), one("2023-24", "2024-25", "", None, "1999-00"), rnd.random() < 0.9, day(), one("in", "out", "unclear"), one("loan", "permanent", "unclear"), fee()) for i in range(400)]
    return claims, moves


CLAIM = "claim_id int, player string, club string, clubs array<string>, season string, related boolean, published date, direction string, kind string, fee double"
MOVE = "move_id string, m_player string, club string, season string, m_date date, m_direction string, m_kind string, m_loan boolean, m_fee double"


def test_matches_by_hand(spark, told):
    claims, moves = told
    got = {r.claim_id: (r.status, r.move_id, r.ambiguous) for r in matching.best_matches(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(moves, MOVE)).collect()}
    want = matches_by_hand(claims, moves)
    assert got == want
    assert {s for s, _, _ in want.values()} == {"not_transfer_related", "no_candidates", "missing_player_signal", "score_below_threshold", "matched"}
    assert any(a for _, _, a in want.values())


def test_candidates_of_large_pools_stay_few(spark):
    """2,000 claims about a pool of 20,000 moves make 4 x 10^7 pairs; blocks of names give one or two each, each pair once."""
    moves = spark.range(20_000).select(F.concat(F.lit("m"), "id").alias("move_id"), F.concat(F.lit("Pat Surname"), F.col("id") % 10_000).alias("m_player"), F.lit("Red").alias("club"), F.lit("2023-24").alias("season"), F.expr("date_add(date'2023-07-01', cast(id % 365 as int))").alias("m_date"), F.lit("in").alias("m_direction"), F.lit("loan").alias("m_kind"), F.lit(True).alias("m_loan"), F.lit(1e6).alias("m_fee"))
    claims = spark.range(2_000).select(F.col("id").alias("claim_id"), F.concat(F.lit("Pat Surname"), "id").alias("player"), F.lit("Red").alias("club"), F.lit("2023-24").alias("season"), F.expr("date'2023-09-01'").alias("published"), F.lit("in").alias("direction"), F.lit("loan").alias("kind"), F.lit(1e6).alias("fee"))
    c = matching._numbered(claims)
    m = matching._keyed_moves(moves, c)
    c = c.join(matching._pools(c, m)[1], "_row")
    pairs = matching.named_pairs(c, m).select("claim_id", "move_id")
    assert pairs.count() == pairs.distinct().count() == 4_000
    best = matching.best_matches(claims, moves)
    assert best.where("status = 'matched' and candidates = 20000").count() == 2_000


def test_confirmed_links_in_rows_and_by_windows(spark):
    """Both ways give the plain answer; moves that are alike in everything count each."""
    rnd = random.Random(5)
    day = lambda: DAY + dt.timedelta(rnd.randrange(900))
    signals = [(i, rnd.choice(["Ann", " ann ", "Bo", "Cy", None]), rnd.choice([1, 2, 3, None]), rnd.choice(["in", "out", None]), rnd.choice([day(), None])) for i in range(120)]
    moves = [(f"m{rnd.randrange(60)}", rnd.choice(["Ann", "BO", None]), rnd.choice([1, 2, 3, 4, None]), rnd.choice(["in", "out"]), rnd.choice([day(), None])) for _ in range(150)]
    moves += [("same", "Bo", 2, "in", DAY)] * 5
    s = spark.createDataFrame(signals, "signal_id INT, player STRING, club INT, role STRING, day DATE")
    m = spark.createDataFrame(moves, "move_id STRING, player STRING, m_club INT, m_role STRING, m_day DATE")
    want = links_by_hand(signals, moves, 3)
    for limits in ({}, {"moves_held": 60}, {"pairs_held": 1}):
        assert sorted(tuple(r) for r in cases.confirmed_links(s, m, **limits).collect()) == want


def test_what_if_bounds_round_as_their_sum(spark):
    """A bound that stands for an exact half (0.0050005) rounds up, as it does where the terms are subtracted one by one."""
    deal = (26273.7, 1050.17, 5000000.0, 28.0, False, "in", "agreed", None, 22 / 30)
    d = spark.createDataFrame([deal], "market_value_eur DOUBLE, transfer_fee_eur DOUBLE, wage_eur_annual DOUBLE, age DOUBLE, is_loan BOOLEAN, direction STRING, stage STRING, source_rate DOUBLE, journalist_rate DOUBLE")
    r = cases.what_if(d).first()
    assert (r.midpoint, r.confidence, r.low, r.label) == (0.0343, 0.7489, 0.005001, "positive")


def test_candidate_pools_write_no_moves(spark):
    """Pools are counted by keys; no table of moves is written for them."""
    rows = [(f"m{i}", f"Pat {i}", f"Club {i % 3}" if i % 7 else None, "2020-21" if i % 2 else "2021-22", DAY, "in", "loan", True, 1.0) for i in range(50)]
    moves = spark.createDataFrame(rows, MOVE)
    told = [(1, "Pat 1", "Club 1", "2020-21"), (2, "Pat 2", "Club 2", " "), (3, "Pat 3", None, None), (4, "Pat 4", "Nowhere", "2020-21"), (1, "Pat 5", "Club 0", None)]
    claims = spark.createDataFrame([(i, p, c, [], s, True, DAY, "in", "loan", 1.0) for i, p, c, s in told], CLAIM)
    counted = matching._counted_moves(moves, matching._numbered(claims, named=False))
    assert set(counted.columns) == {"k_club", "k_season", "n"}
    size = lambda f: sum(1 for r in rows if f(r))
    want = [(1, size(lambda r: r[2:4] == ("Club 1", "2020-21")), "clubs"), (1, size(lambda r: r[2] == "Club 0"), "clubs"), (2, size(lambda r: r[2] == "Club 2"), "clubs"), (3, 50, "all"), (4, 0, "none")]
    assert sorted((r.claim_id, r.candidates, r.pool) for r in matching.candidate_pools(claims, moves).collect()) == sorted(want)


def test_rivals_are_scored_in_cells(spark):
    """A claim without a club has 20,000 moves as its pool; those alike in day and step of fee are one cell."""
    moves = spark.range(20_000).select(F.concat(F.lit("m"), "id").alias("move_id"), F.concat(F.lit("Kim Other"), "id").alias("m_player"), F.lit("Red").alias("club"), F.lit("2023-24").alias("season"), F.expr("date_add(date'2023-09-01', cast(id % 10 as int))").alias("m_date"), F.lit("in").alias("m_direction"), F.lit("loan").alias("m_kind"), F.lit(True).alias("m_loan"), (1e6 + F.col("id")).alias("m_fee"))
    told = spark.createDataFrame([(1, "Kim Other7 Jr", None, None, None, True, dt.date(2023, 9, 3), "in", "loan", 1e6)], CLAIM)
    m = matching._keyed_moves(moves, matching._numbered(told))
    assert matching._cells(m).count() <= 40
    r = matching.best_matches(told, moves).first()
    assert (r.status, r.move_id, r.score, r.ambiguous, r.candidates) == ("matched", "m7", 0.46, 0, 20_000)


@pytest.mark.parametrize("whole, pairs, claimed", [(10_000, 40, 3), (9, 50_000_000, 100_000), (0, 1, 1)])
def test_pools_as_a_whole_and_in_blocks(spark, told, monkeypatch, whole, pairs, claimed):
    """Pools in several parts, some in blocks, and all in blocks give the plain answer."""
    for name, value in (("WHOLE_POOL", whole), ("PART_PAIRS", pairs), ("PART_CLAIMS", claimed)):
        monkeypatch.setattr(matching, name, value)
    claims, moves = told
    moves = moves + [("z1", "Pat Poe", "Red", None, DAY, "in", "loan", True, 1e6), ("z2", "Pat Poe", None, "2023-24", DAY, "in", "loan", True, 1e6), ("z3", None, "Blue", None, DAY, "out", "loan", False, None)]
    got = {r.claim_id: (r.status, r.move_id, r.ambiguous) for r in matching.best_matches(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(moves, MOVE)).collect()}
    assert got == matches_by_hand(claims, moves)


def test_small_pools_are_read_once(spark, monkeypatch):
    """Moves of small pools are written once and meet their claims in one step: no blocks, cells or pairs are written for them."""
    tables = []
    kept = lambda df, name, **options: tables.append(name) or matching_written(df, name, **options)
    matching_written = matching.written
    monkeypatch.setattr(matching, "written", kept)
    moves = spark.range(300).select(F.concat(F.lit("m"), "id").alias("move_id"), F.concat(F.lit("Pat Surname"), "id").alias("m_player"), F.concat(F.lit("Club "), F.col("id") % 10).alias("club"), F.lit("2023-24").alias("season"), F.lit(DAY).alias("m_date"), F.lit("in").alias("m_direction"), F.lit("loan").alias("m_kind"), F.lit(True).alias("m_loan"), F.lit(1e6).alias("m_fee"))
    claims = spark.range(300).select(F.col("id").alias("claim_id"), F.concat(F.lit("P Surname"), "id").alias("player"), F.concat(F.lit("Club "), F.col("id") % 10).alias("club"), F.lit("2023-24").alias("season"), F.lit(DAY).alias("published"), F.lit("in").alias("direction"), F.lit("loan").alias("kind"), F.lit(1e6).alias("fee"))
    assert matching.best_matches(claims, moves).where("status = 'matched' and reasons like 'surname_player|%' and candidates = 30").count() == 300
    assert tables.count("pool-moves") == 1 and not {"named-pairs", "pool-blocks", "pool-cells", "frequent"} & set(tables)


def test_moves_stand_once_where_claims_ask_for_all(spark, monkeypatch):
    """A claim without a club takes all moves; they are keyed for that once, and far rivals open no block of them."""
    tables = {}
    matching_written, keyed = matching.written, matching._wide_moves

    def kept(df, name, **options):
        tables[name] = matching_written(df, name, **options)
        return tables[name]

    def wide(*given):
        tables["wide"] = keyed(*given)
        return tables["wide"]

    monkeypatch.setattr(matching, "written", kept)
    monkeypatch.setattr(matching, "_wide_moves", wide)
    rows = [(f"m{i:03}", f"Pat Surname{i}", f"Club {i % 5}" if i % 9 else None, "2023-24", DAY, "in", "loan", True, 1e6) for i in range(200)]
    asked = [(i, f"P Surname{i}", None if i % 4 else "Club 1", None, None if i % 3 else "2023-24", True, DAY, "in", "loan", 1e6) for i in range(200)]
    r = matching.best_matches(spark.createDataFrame(asked, CLAIM), spark.createDataFrame(rows, MOVE)).where("status = 'matched' and candidates = 200")
    assert r.count() == 150 and tables["wide"].count() == 200 and tables["pool-opened"].count() == 0
