"""Queries over deals and scored cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates, scoring
from tidemark.operators import cases as cs
from tidemark.sources import bindings as b
from tidemark.sources.tables import table

from .registry import query
from .sql_bindings import PREDICTIONS, TRANSFERS

_C = lambda x: f"greatest(0, least(1, {x}))"
_QUALITY = "round(1e-9 + " + _C(f"0.45 * {_C('0.5 + gap / 2')} + 0.30 * {_C('''CASE WHEN direction = 'in' THEN 1 - abs(age - 24) / 12 ELSE 0.65 + greatest(age - 27, 0) / 12 END''')} + 0.25 * (1 - 0.35 * {_C('wage_eur_annual / 25000000')})") + ", 4)"
_SCORED = f"""{TRANSFERS}, tg AS (SELECT *, CASE WHEN market_value_eur > 0 THEN CASE WHEN direction = 'in' THEN market_value_eur - transfer_fee_eur ELSE transfer_fee_eur - market_value_eur END / market_value_eur ELSE 0 END AS gap,
  CASE WHEN market_value_eur > 0 AND transfer_fee_eur > 0 THEN round(transfer_fee_eur / market_value_eur, 4) ELSE 0 END AS ratio FROM transfers),
tq AS (SELECT *, {_QUALITY} AS quality FROM tg),
ti AS (SELECT *, round(1e-9 + {_C(f'''0.50 * quality + 0.30 * CASE WHEN ratio <= 0 THEN 0.5 WHEN direction = 'in' THEN {_C('1.15 - ratio')} ELSE {_C('0.5 + (ratio - 1) / 2')} END + 0.20 * {_C("CASE WHEN direction = 'in' THEN 1 - abs(age - 24) / 12 ELSE 0.55 + greatest(age - 26, 0) / 14 END")} - CASE WHEN is_loan THEN 0.08 ELSE 0 END''')}, 4) AS indicator FROM tq)"""


def scored_moves(spark, sf_dir):
    t = b.transfers(spark, sf_dir)
    fields = [F.col(c) for c in ("direction", "market_value_eur", "transfer_fee_eur", "wage_eur_annual", "age")]
    return t.withColumns({"quality": scoring.rounded(scoring.transfer_quality(*fields)), "indicator": scoring.rounded(scoring.transfer_indicator(*fields, F.col("is_loan"))), "ratio": F.round(scoring.fee_to_market(F.col("transfer_fee_eur"), F.col("market_value_eur")), 4)})


@query("transfer_quality", f"WITH {_SCORED} SELECT deal_id, line, direction, quality, ratio FROM ti")
def transfer_quality(spark, sf_dir):
    return scored_moves(spark, sf_dir).select("deal_id", "line", "direction", "quality", "ratio")


@query("transfer_indicator", f"WITH {_SCORED} SELECT deal_id, line, player_id, is_loan, indicator FROM ti")
def transfer_indicator(spark, sf_dir):
    return scored_moves(spark, sf_dir).select("deal_id", "line", "player_id", "is_loan", "indicator")


def listed(spark, sf_dir):
    """Nations of the even regions stand for clubs with shares."""
    return table(spark, sf_dir, "nation").where("n_regionkey % 2 = 0").select(F.col("n_nationkey").alias("club_id"), F.col("n_name").alias("club_name"))


_TARGETS = f"""{TRANSFERS}, li AS (SELECT n_nationkey AS club_id, n_name AS club_name FROM nation WHERE n_regionkey % 2 = 0),
sides AS (SELECT t.*, b.club_name AS buyer, CASE WHEN s.club_id IS DISTINCT FROM b.club_id THEN s.club_name END AS seller FROM transfers t LEFT JOIN li b ON t.to_id = b.club_id LEFT JOIN li s ON t.from_id = s.club_id),
targets AS (SELECT *, buyer AS target_club, 'buyer' AS target_role, 'direct' AS prediction_scope FROM sides WHERE buyer IS NOT NULL UNION ALL SELECT *, seller, 'seller', 'direct' FROM sides WHERE seller IS NOT NULL
  UNION ALL SELECT *, NULL, NULL, 'none' FROM sides WHERE buyer IS NULL AND seller IS NULL)"""


@query("target_expansion", f"WITH {_TARGETS} SELECT deal_id, line, target_club, target_role, prediction_scope, CAST(buyer IS NOT NULL AS INTEGER) + CAST(seller IS NOT NULL AS INTEGER) AS public_target_count FROM targets")
def target_expansion(spark, sf_dir):
    out = cs.targets(b.transfers(spark, sf_dir), listed(spark, sf_dir))
    return out.select("deal_id", "line", "target_club", "target_role", "prediction_scope", "public_target_count")


_SEASON = "CAST(year(date) - CAST(month(date) < 7 AS INTEGER) AS VARCHAR) || '-' || lpad(CAST((year(date) - CAST(month(date) < 7 AS INTEGER) + 1) % 100 AS VARCHAR), 2, '0')"


@query("claim_dataset", f"WITH {_TARGETS} SELECT {_SEASON} AS season, target_club, target_role, count(*) AS n_rows, count_if(is_loan) AS n_loans, round(sum(transfer_fee_eur), 2) AS fees, min(date) AS first_date FROM targets WHERE prediction_scope = 'direct' GROUP BY 1, 2, 3")
def claim_dataset(spark, sf_dir):
    """Rows of the prediction data by season, target and role."""
    t = cs.targets(b.transfers(spark, sf_dir), listed(spark, sf_dir)).where("prediction_scope = 'direct'")
    return t.groupBy(dates.season(F.col("date")).alias("season"), "target_club", "target_role").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_loan").alias("n_loans"), F.round(F.sum("transfer_fee_eur"), 2).alias("fees"), F.min("date").alias("first_date"))


@query(
    "season_rollup",
    f"""WITH {_SCORED} SELECT {_SEASON} AS season, direction, count(*) AS transfer_count, round(avg(indicator), 4) AS avg_index, count_if(is_loan) AS loans, count(DISTINCT player_id) AS players, arg_max(deal_id, (indicator, -deal_id)) AS best_deal FROM ti GROUP BY 1, 2""",
)
def season_rollup(spark, sf_dir):
    t = scored_moves(spark, sf_dir).withColumn("season", dates.season(F.col("date")))
    return t.groupBy("season", "direction").agg(
        F.count(F.lit(1)).alias("transfer_count"), F.round(F.avg("indicator"), 4).alias("avg_index"), F.count_if("is_loan").alias("loans"), F.countDistinct("player_id").alias("players"), F.max_by("deal_id", F.struct("indicator", -F.col("deal_id"))).alias("best_deal")
    )


_STAGE = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in scoring.STAGE_SCORES.items()) + " ELSE 0.4e0 END"


@query(
    "whatif_scores",
    f"""WITH {_SCORED}, d AS (SELECT *, CASE WHEN deal_id % 3 = 0 THEN NULL ELSE (deal_id % 41) / 40.0e0 END AS sr, CASE WHEN deal_id % 4 = 0 THEN NULL ELSE (player_id % 31) / 30.0e0 END AS jr, (['linked', 'talks', 'bid', 'advanced', 'agreed', 'medical', 'official', 'unclear'])[line % 8 + 1] AS stage FROM ti),
    e AS (SELECT *, round(1e-9 + coalesce(0.45 * sr + 0.55 * jr, jr, sr, 0.5), 4) AS credibility, {_STAGE('stage')} AS ss FROM d),
    f AS (SELECT *, round(1e-9 + {_C('0.58 * credibility + 0.32 * ss + 0.10e0 * CASE WHEN is_loan THEN 0.35 ELSE 0.55 END')}, 4) AS rumor FROM e),
    g AS (SELECT *, round(1e-9 + greatest(-0.08, least(0.08, (rumor - 0.5) * 0.05 + (indicator - 0.5) * 0.06 * CASE WHEN direction = 'in' THEN 1 ELSE 0.65 END)), 4) AS midpoint, round(1e-9 + {_C('0.35 + 0.45 * rumor')}, 4) AS belief FROM f),
    h AS (SELECT *, round(1e-9 + {_C('0.35 * credibility + 0.35 * ss + 0.30 * belief')}, 4) AS confidence FROM g), i AS (SELECT *, round(greatest(-0.10, midpoint - 0.018 - (1 - confidence) * 0.045), 6) AS lo, round(least(0.10, midpoint + 0.018 + (1 - confidence) * 0.045), 6) AS hi FROM h)
    SELECT deal_id, line, player_id, CASE WHEN lo > 0.005 THEN 'positive' WHEN hi < -0.005 THEN 'negative' ELSE 'watch' END AS label, credibility, midpoint FROM i""",
)
def whatif_scores(spark, sf_dir):
    t = b.transfers(spark, sf_dir)
    k = F.col("deal_id")
    stage = F.element_at(F.array(*map(F.lit, ("linked", "talks", "bid", "advanced", "agreed", "medical", "official", "unclear"))), (F.col("line") % 8 + 1).cast("int"))
    d = t.withColumns({"source_rate": F.when(k % 3 != 0, (k % 41) / 40.0), "journalist_rate": F.when(k % 4 != 0, (F.col("player_id") % 31) / 30.0), "stage": stage})
    return cs.what_if(d).select("deal_id", "line", "player_id", "label", "credibility", "midpoint")


_SIM = """CASE WHEN a.club = h.club THEN 0.16e0 ELSE 0 END + CASE WHEN a.direction = h.direction THEN 0.18e0 ELSE -0.08e0 END + CASE WHEN a.target_role = h.target_role THEN 0.10e0 ELSE 0 END + CASE WHEN a.source = h.source THEN 0.12e0 ELSE 0 END
 + greatest(0, 0.18 - abs(a.credibility_score - h.credibility_score) * 0.30) + greatest(0, 0.16 - abs(a.transfer_indicator - h.transfer_indicator) * 0.28) + greatest(0, 0.10 - abs(a.rumor_stage_score - h.rumor_stage_score) * 0.20)
 + greatest(0, 0.08 - abs(a.stock_context_indicator - h.stock_context_indicator) * 0.16) + greatest(0, 0.08 - abs(a.age - h.age) / 20) + greatest(0, 0.12 - abs(a.market_value_eur - h.market_value_eur) / 250000000)"""


@query(
    "similar_cases",
    f"""WITH {PREDICTIONS}, pairs AS (SELECT a.case_id AS q, h.case_id AS c, round({_SIM}, 6) AS similarity FROM predictions a JOIN predictions h ON a.target_role = h.target_role AND a.direction = h.direction WHERE a.case_id % 50 = 0 AND h.split = 'train')
    SELECT q, c, rank, similarity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, c) AS rank FROM pairs) WHERE rank <= 3""",
)
def similar_cases(spark, sf_dir):
    """Stated query set (ids divisible by 50) against all past cases."""
    p = b.predictions(spark, sf_dir)
    fields = ["case_id", "club", "direction", "target_role", "position", "credibility_score", "transfer_indicator", "rumor_stage_score", "stock_context_indicator", "age", "market_value_eur"]
    p = p.withColumn("position", F.col("source"))
    found = cs.similar_cases(p.where("case_id % 50 = 0").select(*fields), p.where("split = 'train'").select(*fields))
    return found.select(F.col("q_case_id").alias("q"), F.col("case_id").alias("c"), F.col("rank").cast("bigint").alias("rank"), "similarity")


@query(
    "confirmed_links",
    f"""WITH {TRANSFERS}, s AS (SELECT o_orderkey AS signal_id, 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS p, CAST(o_orderkey % 25 AS INTEGER) AS club, CASE WHEN o_orderkey % 2 = 0 THEN 'in' ELSE 'out' END AS role, CAST(o_orderdate AS DATE) AS day FROM orders),
    m AS (SELECT deal_id || '-' || line || '-' || CAST(round(wage_eur_annual) AS BIGINT) || '-' || to_id || '-' || CAST(round(market_value_eur) AS BIGINT) AS move_id, lower(player) AS p, to_id, direction, date FROM transfers),
    j AS (SELECT signal_id, move_id, date, round(CASE WHEN club = to_id THEN 0.55e0 ELSE 0 END + CASE WHEN role = direction THEN 0.20e0 ELSE 0 END + greatest(0, 0.17e0 - least(abs(date_diff('day', date, day)), 365) / 365.0e0 * 0.17e0), 6) AS score FROM s JOIN m USING (p))
    SELECT signal_id, move_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY score DESC, date DESC, move_id) AS rank FROM j WHERE score > 0) WHERE rank <= 3""",
)
def confirmed_links(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    signals = o.select(k.alias("signal_id"), F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("player"), (k % 25).cast("int").alias("club"), F.when(k % 2 == 0, "in").otherwise("out").alias("role"), F.to_date("o_orderdate").alias("day"))
    t = b.transfers(spark, sf_dir)
    move_id = F.concat_ws("-", "deal_id", "line", F.round("wage_eur_annual").cast("bigint"), "to_id", F.round("market_value_eur").cast("bigint"))
    moves = t.select(move_id.alias("move_id"), "player", F.col("to_id").alias("m_club"), F.col("direction").alias("m_role"), F.col("date").alias("m_day"))
    return cs.confirmed_links(signals, moves).withColumn("rank", F.col("rank").cast("bigint"))


def signals(spark, sf_dir):
    p = b.predictions(spark, sf_dir)
    i = F.col("case_id")
    return p.select(
        i.alias("signal_id"),
        F.col("target_role").alias("role"),
        (i % 7 * 10_000_000.0).alias("fee"),
        F.col("market_value_eur").alias("market_value"),
        "transfer_indicator",
        "age",
        F.when(i % 6 == 0, "Striker").otherwise("Keeper").alias("position"),
        F.col("predicted_label").alias("label"),
        "prediction_confidence",
        F.col("credibility_score").alias("credibility"),
        (i % 5).cast("int").alias("sources"),
        F.when(i % 9 == 0, "unclear").otherwise(F.col("rumor_stage")).alias("stage"),
        F.when(i % 3 != 0, F.col("journalist_rep")).alias("reporter_rate"),
        (i % 2 == 0).alias("has_link"),
        (i % 10 < 7).alias("has_similar"),
    )


_SIGNALS = f"""{PREDICTIONS}, sg AS (SELECT case_id AS signal_id, target_role AS role, case_id % 7 * 10000000.0e0 AS fee, market_value_eur AS mv, transfer_indicator AS ti, age, CASE WHEN case_id % 6 = 0 THEN 1 ELSE 0 END AS attack, predicted_label AS label, prediction_confidence AS pc, credibility_score AS cr, case_id % 5 AS sources,
  CASE WHEN case_id % 9 = 0 THEN 'unclear' ELSE rumor_stage END AS stage, CASE WHEN case_id % 3 <> 0 THEN journalist_rep END AS rr, case_id % 2 = 0 AS link, case_id % 10 < 7 AS sim FROM predictions)"""
_LABEL = lambda s: f"CASE WHEN {s} >= 0.35 THEN 'bullish' WHEN {s} <= -0.35 THEN 'bearish' WHEN abs({s}) <= 0.12 THEN 'neutral' ELSE 'watch' END"


@query(
    "stance_consensus",
    f"""WITH {_SIGNALS}, s AS (SELECT *, round(CASE role WHEN 'seller' THEN 0.25e0 ELSE -0.15e0 END + CASE WHEN fee > 0 AND mv > 0 AND fee <= mv * 0.9 THEN 0.15e0 WHEN fee > 0 AND mv > 0 AND fee > mv * 1.15 THEN -0.15e0 ELSE 0 END + CASE WHEN ti >= 0.6 THEN CASE role WHEN 'buyer' THEN 0.10e0 ELSE 0.05e0 END ELSE 0 END + CASE WHEN age >= 31 AND role = 'seller' THEN 0.10e0 ELSE 0 END, 6) AS a,
      round(CASE label WHEN 'positive' THEN 0.35e0 WHEN 'negative' THEN -0.35e0 ELSE 0 END * CASE WHEN pc >= 0.65 THEN 1.15e0 ELSE 1 END, 6) AS b,
      round(CASE WHEN cr >= 0.6 THEN 0.25e0 WHEN cr < 0.4 THEN -0.15e0 ELSE 0 END + CASE WHEN sources >= 3 THEN 0.12e0 ELSE 0 END + CASE WHEN stage IN ('advanced', 'agreed', 'medical', 'official') THEN 0.15e0 ELSE 0 END + coalesce(least(0.12e0, rr * 0.12e0), 0), 6) AS c,
      round(CASE role WHEN 'seller' THEN CASE WHEN age >= 30 THEN 0.12e0 ELSE -0.18e0 END ELSE 0.10e0 END + attack * 0.04e0, 6) AS d,
      round(-(CASE WHEN cr < 0.5 THEN 0.18e0 ELSE 0 END + CASE WHEN sources <= 1 THEN 0.12e0 ELSE 0 END + CASE WHEN stage IN ('unclear', 'linked') THEN 0.12e0 ELSE 0 END + CASE WHEN link THEN 0 ELSE 0.08e0 END + CASE WHEN sim THEN 0 ELSE 0.05e0 END), 6) AS e FROM sg),
    v AS (SELECT signal_id, {_LABEL('a')} AS st, round(least(1, 0.48e0 + abs(a)), 4) AS cf FROM s UNION ALL SELECT signal_id, {_LABEL('b')}, round(least(1, 0.50e0 + abs(b)), 4) FROM s UNION ALL SELECT signal_id, CASE WHEN c > 0 AND cr < 0.6 THEN 'watch' ELSE {_LABEL('c')} END, round(least(1, 0.45e0 + abs(c)), 4) FROM s
      UNION ALL SELECT signal_id, {_LABEL('d')}, round(least(1, 0.42e0 + abs(d)), 4) FROM s UNION ALL SELECT signal_id, CASE WHEN e > -0.2 THEN 'watch' ELSE 'bearish' END, round(least(1, 0.50e0 + abs(e)), 4) FROM s),
    g AS (SELECT signal_id, round(sum(CASE st WHEN 'bullish' THEN cf WHEN 'bearish' THEN -cf ELSE 0 END) / sum(cf), 6) AS score, count_if(st = 'bullish') AS bullish, count_if(st = 'bearish') AS bearish, count_if(st = 'watch') AS watch, count_if(st = 'neutral') AS neutral FROM v GROUP BY 1)
    SELECT signal_id, round(score, 3) AS score, bullish, bearish, watch, neutral, {_LABEL('score')} AS stance FROM g""",
)
def stance_consensus(spark, sf_dir):
    return cs.stance_consensus(cs.stances(signals(spark, sf_dir))).drop("confidence").withColumn("score", F.round("score", 3))


@query(
    "decision_queue",
    f"""WITH {PREDICTIONS}, q AS (SELECT case_id AS signal_id, case_id % 4 <> 1 AS direct, credibility_score AS cr, case_id % 5 AS sources, round(CASE WHEN case_id % 4 <> 1 THEN 0.25e0 ELSE 0 END + 0.24 * credibility_score + 0.18 * prediction_confidence + 0.14e0 * least(1, (case_id % 5) / 4)
      + 0.11 * CASE rumor_stage WHEN 'official' THEN 1.0e0 WHEN 'medical' THEN 0.92e0 WHEN 'agreed' THEN 0.86e0 WHEN 'advanced' THEN 0.76e0 WHEN 'bid' THEN 0.62e0 WHEN 'talks' THEN 0.5e0 WHEN 'linked' THEN 0.28e0 ELSE 0.2e0 END + 0.08e0 * least(1, (case_id % 71) / 70.0e0), 4) AS priority FROM predictions)
    SELECT signal_id, priority, CASE WHEN NOT direct THEN 'credibility_only' WHEN priority >= 0.66 AND sources >= 2 THEN 'monitor' WHEN priority >= 0.48 OR cr >= 0.55 THEN 'verify' ELSE 'background' END AS action FROM q ORDER BY priority DESC, signal_id LIMIT 6""",
)
def decision_queue(spark, sf_dir):
    """The six most urgent signals."""
    p = b.predictions(spark, sf_dir)
    i = F.col("case_id")
    s = p.select(i.alias("signal_id"), (i % 4 != 1).alias("direct"), F.col("rumor_stage").alias("stage"), F.col("credibility_score").alias("credibility"), "prediction_confidence", (i % 5).alias("sources"), (i % 71).cast("double").alias("blended"))
    return cs.queue(s).select("signal_id", "priority", "action")


@query(
    "run_diff",
    f"""WITH {PREDICTIONS} SELECT coalesce(o.case_id, n.case_id) AS case_id, CASE WHEN o.case_id IS NULL THEN 'new' WHEN n.case_id IS NULL THEN 'dropped' WHEN o.label <> n.label THEN 'changed' ELSE 'same' END AS change
    FROM (SELECT case_id, predicted_label AS label FROM predictions) o FULL JOIN (SELECT case_id, actual_label AS label FROM predictions) n ON o.case_id = n.case_id""",
)
def run_diff(spark, sf_dir):
    """Predicted against actual labels of all cases."""
    p = b.predictions(spark, sf_dir)
    old = p.select("case_id", F.col("predicted_label").alias("label"))
    new = p.select("case_id", F.col("actual_label").alias("label"))
    return cs.run_difference(old, new, "case_id", "label").select("case_id", "change")


_CLUBS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "comparison_pivot",
    f"WITH {PREDICTIONS}, m AS (SELECT club, unnest(['signals', 'credibility', 'positive_share']) AS metric, unnest([count(*)::DOUBLE, avg(credibility_score), avg(CAST(actual_label = 'positive' AS INTEGER))]) AS v FROM predictions GROUP BY club) SELECT metric, "
    + ", ".join(f"round(max(v) FILTER (WHERE club = '{c}'), 4) AS {c.lower()}" for c in _CLUBS)
    + " FROM m GROUP BY metric",
)
def comparison_pivot(spark, sf_dir):
    """Metrics by club, side by side."""
    p = b.predictions(spark, sf_dir)
    g = p.groupBy("club").agg(F.count(F.lit(1)).cast("double").alias("signals"), F.avg("credibility_score").alias("credibility"), F.avg((F.col("actual_label") == "positive").cast("int")).alias("positive_share"))
    long = g.unpivot("club", ["signals", "credibility", "positive_share"], "metric", "v")
    return long.groupBy("metric").pivot("club", list(_CLUBS)).agg(F.round(F.first("v"), 4)).withColumnsRenamed({c: c.lower() for c in _CLUBS})


@query(
    "club_dossier",
    f"""WITH {PREDICTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY club ORDER BY signal_date DESC, case_id DESC) AS k FROM predictions),
    a AS (SELECT club, count(*) AS n_signals, round(avg(credibility_score) + 1e-9, 4) AS avg_credibility, round(avg(prob_positive) FILTER (WHERE k <= 12), 4) AS recent_positive, round(avg(CAST(actual_label = 'positive' AS INTEGER)), 4) AS positive_share, arg_max(case_id, (prob_positive, -case_id)) AS peak_case, arg_max(case_id, (prob_negative, -case_id)) AS low_case FROM r GROUP BY club),
    p AS (SELECT club, player, count(*) AS n FROM predictions GROUP BY 1, 2), t AS (SELECT club, string_agg(player || ':' || n, '|' ORDER BY k) AS top_players FROM (SELECT *, row_number() OVER (PARTITION BY club ORDER BY n DESC, player) AS k FROM p) WHERE k <= 5 GROUP BY 1)
    SELECT a.*, top_players FROM a JOIN t USING (club)""",
)
def club_dossier(spark, sf_dir):
    """Each club's signals, latest twelve, extremes and most frequent players."""
    p = b.predictions(spark, sf_dir)
    latest = p.withColumn("k", F.row_number().over(Window.partitionBy("club").orderBy(F.desc("signal_date"), F.desc("case_id")))).where("k <= 12").groupBy("club").agg(F.round(F.avg("prob_positive"), 4).alias("recent_positive"))
    base = p.groupBy("club").agg(
        F.count(F.lit(1)).alias("n_signals"),
        scoring.rounded(F.avg("credibility_score")).alias("avg_credibility"),
        F.round(F.avg((F.col("actual_label") == "positive").cast("int")), 4).alias("positive_share"),
        F.max_by("case_id", F.struct("prob_positive", -F.col("case_id"))).alias("peak_case"),
        F.max_by("case_id", F.struct("prob_negative", -F.col("case_id"))).alias("low_case"),
    )
    n = p.groupBy("club", "player").agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("k", F.row_number().over(Window.partitionBy("club").orderBy(F.desc("n"), "player"))).where("k <= 5")
    players = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "player", "n"))), lambda x: F.concat_ws(":", x["player"], x["n"])), "|")
    return base.join(latest, "club").join(top.groupBy("club").agg(players.alias("top_players")), "club")
