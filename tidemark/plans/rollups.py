"""Queries that roll scored signals, moves and claims up: summaries, histories, leaders, trust graph, headline cards, views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates, scoring
from tidemark.operators import cases as cs
from tidemark.operators import frames as fr
from tidemark.operators import modelling as md
from tidemark.operators import rollups as ru
from tidemark.sources import bindings as b
from tidemark.sources.tables import table

from .cases import _SCORED, _SEASON, _TARGETS, listed, scored_moves
from .claims import _JUDGED, judged_claims
from .market import _model_sql, _rows, points
from .registry import query
from .signals import _GRAPH, graph_rows
from .sql_bindings import CLAIMS, MARKET, PREDICTIONS, TRANSFERS

_BLEND = "round(greatest(-1, least(1, 0.45 * (prob_positive - prob_negative) + 0.20e0 * CASE direction WHEN 'in' THEN 1 WHEN 'out' THEN -1 ELSE 0 END * transfer_indicator + 0.30e0 * (credibility_score - 0.5) + 0.20e0 * (rumor_stage_score - 0.5) + 0.20e0 * (stock_context_indicator - 0.5))) * 100, 2)"


def blended(spark, sf_dir):
    c = F.col
    score = scoring.blended(c("prob_positive"), c("prob_negative"), c("direction"), c("transfer_indicator"), c("credibility_score"), c("rumor_stage_score"), c("stock_context_indicator"))
    return b.predictions(spark, sf_dir).withColumns({"blended": score, "journalist": F.concat(F.lit("kim "), c("case_id") % 17), "direct": c("case_id") % 4 != 1})


_SIGNALS = f"{PREDICTIONS}, sg AS (SELECT *, {_BLEND} AS blended, 'kim ' || (case_id % 17) AS journalist, case_id % 4 <> 1 AS direct FROM predictions)"


@query(
    "signal_summaries",
    f"""WITH {_SIGNALS}, g AS (SELECT club, player, count(*) AS article_count, count(DISTINCT source) AS source_count, count(DISTINCT journalist) AS reporter_count, arg_max(case_id, (signal_date, case_id)) AS latest, arg_max(blended, (signal_date, case_id)) AS blended FROM sg GROUP BY 1, 2),
    v AS (SELECT club, player, string_agg(predicted_label || ':' || n, '|' ORDER BY predicted_label) AS label_mix FROM (SELECT club, player, predicted_label, count(*) AS n FROM sg GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT club, player, latest AS case_id, blended, article_count, source_count, reporter_count, label_mix FROM g JOIN v USING (club, player)""",
)
def signal_summaries(spark, sf_dir):
    """The latest signal of each club and player with what stands behind it."""
    s = md.latest_signals(blended(spark, sf_dir), ["club", "player"], ["signal_date", "case_id"])
    return s.select("club", "player", "case_id", "blended", "article_count", "source_count", "reporter_count", "label_mix")


@query(
    "event_news",
    f"""WITH {TRANSFERS}, n AS (SELECT o_custkey AS player_id, year(o_orderdate) AS year, count(*) AS rumor_count, round(max(o_orderkey % 101) / 100, 4) AS mc, round(avg((o_orderkey % 101) / 100.0e0) + 1e-9, 4) AS ac, round(max(o_orderkey % 89) / 88, 4) AS ms FROM orders GROUP BY 1, 2)
    SELECT deal_id, line, t.player_id, coalesce(rumor_count, 0) AS rumor_count, mc AS max_credibility, ac AS avg_credibility, ms AS max_strength, count(*) AS n FROM transfers t LEFT JOIN n ON n.player_id = t.player_id AND n.year = year(date) GROUP BY ALL""",
)
def event_news(spark, sf_dir):
    """Moves with the news about their player in their year."""
    k = F.col("o_orderkey")
    news = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("year"), ((k % 101) / 100.0).alias("credibility_score"), ((k % 89) / 88.0).alias("rumor_strength"))
    e = md.event_news(b.transfers(spark, sf_dir).withColumn("year", F.year("date")), news, ["player_id", "year"])
    out = e.select("deal_id", "line", "player_id", "rumor_count", F.round("max_credibility", 4).alias("max_credibility"), scoring.rounded(F.col("avg_credibility")).alias("avg_credibility"), F.round("max_rumor_strength", 4).alias("max_strength"))
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


_HISTORY = f"""{MARKET}, {_TARGETS.replace('WITH ', '')}, {_model_sql(-125, -6)},
ar AS (SELECT ticker, date, CASE WHEN count(*) {_rows(0, 3)} = 4 THEN sum(r) {_rows(0, 3)} - 4 * coalesce(alpha, 0) - coalesce(beta, 1) * sum(m) {_rows(0, 3)} END AS car FROM fit),
hs AS (
  SELECT t.deal_id, t.line, t.player_id, t.target_club, t.target_role, t.date AS day, t.transfer_fee_eur, t.is_loan, (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[t.to_id % 5 + 1] AS ticker FROM targets t
  WHERE prediction_scope = 'direct' AND date <= DATE '1998-12-31'),
hm AS (SELECT hs.*, ar.date AS trading_date, ar.car, CASE WHEN car <= -0.02 THEN 'negative' WHEN car >= 0.02 THEN 'positive' WHEN car IS NOT NULL THEN 'neutral' END AS label FROM hs ASOF LEFT JOIN ar ON hs.ticker = ar.ticker AND ar.date >= hs.day)"""


def history(spark, sf_dir):
    """Moves of listed clubs up to a day, with what the shares did after them."""
    tickers = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    sided = cs.targets(b.transfers(spark, sf_dir), listed(spark, sf_dir))
    p = points(spark, sf_dir)
    alpha, beta, _ = fr.market_model(-125, -6)
    bars = p.withColumns({"alpha": F.coalesce(alpha, F.lit(0.0)), "beta": F.coalesce(beta, F.lit(1.0))})
    car = bars.select("ticker", "idx", F.col("date").alias("trading_date"), fr.complete(fr.abnormal(0, 3, F.col("alpha"), F.col("beta")), 0, 3).alias("car"))
    rows = sided.withColumns({"ticker": F.element_at(F.array(*map(F.lit, tickers)), (F.col("to_id") % 5 + 1).cast("int")), "event_date": F.col("date")})
    return ru.transfer_history(rows, p, car, F.lit("1998-12-31").cast("date"))


@query("transfer_history", f"WITH {_HISTORY} SELECT target_club, target_role, label, count(*) AS n, round(avg(car), 6) AS avg_car, max(trading_date) AS last_day FROM hm GROUP BY 1, 2, 3")
def transfer_history(spark, sf_dir):
    h = history(spark, sf_dir)
    return h.groupBy("target_club", "target_role", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("car"), 6).alias("avg_car"), F.max("trading_date").alias("last_day"))


@query(
    "reactive_clubs",
    f"""WITH {_HISTORY}, c AS (SELECT target_club AS club, round(avg(abs(car)), 6) AS avg_abs_car, count(*) AS n_rows FROM hm WHERE car IS NOT NULL GROUP BY 1 HAVING count(*) >= 12)
    SELECT * FROM c ORDER BY avg_abs_car DESC, club LIMIT 1""",
)
def reactive_clubs(spark, sf_dir):
    """The club whose shares react most, of those with twelve moves or more."""
    return ru.most_reactive(history(spark, sf_dir).withColumnRenamed("target_club", "club"), "car", 12)


@query(
    "season_history",
    f"""WITH {_HISTORY}, y AS (SELECT *, {_SEASON.replace('date', 'day')} AS season FROM hm)
    SELECT season, count(*) AS transfer_count, count(label) AS realized_count, round(coalesce(avg(car), 0), 6) AS avg_car, round(coalesce(count_if(label = 'positive') / nullif(count(label), 0), 0), 4) AS positive_share FROM y GROUP BY 1""",
)
def season_history(spark, sf_dir):
    """Moves and their outcomes by season."""
    h = history(spark, sf_dir).withColumn("season", dates.season(F.col("event_date")))
    return ru.season_summary(h)


@query(
    "extreme_cases",
    f"""WITH {_SIGNALS}, d AS (SELECT *, prob_positive - prob_negative AS v FROM sg WHERE direct)
    SELECT club, arg_max(case_id, (v, -case_id)) AS best_case, arg_min(case_id, (v, case_id)) AS worst_case, round(max(v), 4) AS best, round(min(v), 4) AS worst FROM d GROUP BY ROLLUP (club)""",
)
def extreme_cases(spark, sf_dir):
    """The most positive and negative direct cases of each club and of all."""
    d = blended(spark, sf_dir).where("direct").withColumn("v", F.col("prob_positive") - F.col("prob_negative"))
    return ru.extremes(d, ["club"], "v", "case_id").select("club", "best_case", "worst_case", F.round("best", 4).alias("best"), F.round("worst", 4).alias("worst"))


@query(
    "source_mix",
    f"""WITH {CLAIMS}, n AS (SELECT club, source, count(*) AS n FROM claims GROUP BY 1, 2) SELECT club, source, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY club ORDER BY n DESC, source) AS rank FROM n) WHERE rank <= 6""",
)
def source_mix(spark, sf_dir):
    """The six outlets with most claims about each club."""
    return md.most(b.claims(spark, sf_dir), ["club"], "source", 6).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "freshness_meta",
    f"""WITH {CLAIMS}, m AS (SELECT max(published_at) AS latest, count_if(published_at >= TIMESTAMP '2024-02-05' - INTERVAL 21 DAY) AS recent FROM claims)
    SELECT CAST(latest AS DATE) AS latest_day, date_diff('day', CAST(latest AS DATE), DATE '2024-02-05') AS days_stale, 21 AS window_days, date_diff('day', CAST(latest AS DATE), DATE '2024-02-05') > 21 AS is_stale, recent AS recent_count FROM m""",
)
def freshness_meta(spark, sf_dir):
    """How old the coverage is as of a day."""
    return ru.freshness(b.claims(spark, sf_dir), F.lit("2024-02-05").cast("timestamp"), 21)


@query(
    "reporter_pages",
    f"""WITH {_JUDGED}, a AS (SELECT journalist, count(*) AS n_claims, round(avg(match_score), 4) AS avg_score, round((count_if(matched) + 2.5) / (count(*) + 5), 4) AS smoothed_rate FROM judged GROUP BY 1),
    k AS (SELECT journalist, string_agg(club || ':' || n, '|' ORDER BY r) AS clubs FROM (SELECT *, row_number() OVER (PARTITION BY journalist ORDER BY n DESC, club) AS r FROM (SELECT journalist, club, count(*) AS n FROM judged GROUP BY 1, 2)) WHERE r <= 6 GROUP BY 1),
    s AS (SELECT journalist, string_agg(source || ':' || n, '|' ORDER BY r) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY journalist ORDER BY n DESC, source) AS r FROM (SELECT journalist, source, count(*) AS n FROM judged GROUP BY 1, 2)) WHERE r <= 6 GROUP BY 1),
    l AS (SELECT journalist, string_agg(CAST(claim_id AS VARCHAR), '|' ORDER BY r) AS latest FROM (SELECT journalist, claim_id, row_number() OVER (PARTITION BY journalist ORDER BY published_at DESC, claim_id DESC) AS r FROM judged) WHERE r <= 8 GROUP BY 1)
    SELECT a.*, clubs, sources, latest FROM a JOIN k USING (journalist) JOIN s USING (journalist) JOIN l USING (journalist)""",
)
def reporter_pages(spark, sf_dir):
    """Each reporter with six clubs, six outlets and the latest eight claims."""
    return ru.reporter_pages(judged_claims(spark, sf_dir))


@query(
    "trust_graph",
    f"""WITH {_JUDGED}, a AS (SELECT journalist, count(*) AS n_claims, (count_if(matched) + 2.5) / (count(*) + 5) AS rate FROM judged GROUP BY 1 ORDER BY rate DESC, n_claims DESC, journalist LIMIT 8),
    s AS (SELECT *, row_number() OVER (PARTITION BY journalist ORDER BY n DESC, source) AS r FROM (SELECT journalist, source, count(*) AS n FROM judged GROUP BY 1, 2)),
    c AS (SELECT *, row_number() OVER (PARTITION BY journalist ORDER BY n DESC, club) AS r FROM (SELECT journalist, club, count(*) AS n FROM judged GROUP BY 1, 2))
    SELECT 'reporter:' || journalist AS source_id, 'source:' || source AS target_id, 'reported via' AS kind, n AS weight, round(rate, 6) AS score FROM a JOIN s USING (journalist) WHERE r <= 2
    UNION ALL SELECT 'source:' || s.source, 'club:' || club, 'covers', c.n, round(rate, 6) FROM a JOIN c USING (journalist) JOIN s ON s.journalist = a.journalist AND s.r = 1 WHERE c.r <= 3""",
)
def trust_graph(spark, sf_dir):
    """Edges from the eight best reporters to their outlets and from there to the clubs they cover."""
    return ru.trust_edges(judged_claims(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    "graph_summary",
    f"""WITH {_GRAPH}, u AS (SELECT unnest(['club', 'source', 'reporter', 'stage']) AS type, unnest([club, source, journalist, stage]) AS label FROM gr), n AS (SELECT type, label, count(*) AS n FROM u GROUP BY 1, 2)
    SELECT type, label, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, label) AS rank FROM n) WHERE rank <= 8""",
)
def graph_summary(spark, sf_dir):
    """The eight most frequent clubs, outlets, reporters and stages."""
    rows = graph_rows(spark, sf_dir)
    kinds = {"club": "club", "source": "source", "reporter": "journalist", "stage": "stage"}
    each = rows.select(F.inline(F.array(*(F.struct(F.lit(k).alias("type"), F.col(c).alias("label")) for k, c in kinds.items()))))
    return md.most(each, ["type"], "label", 8).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "dimension_counts",
    f"""WITH {CLAIMS}, {TRANSFERS}, a AS (SELECT 'claims' AS t, unnest(['source', 'rumor_stage', 'direction']) AS dimension, unnest([source, rumor_stage, direction]) AS value FROM claims),
    b AS (SELECT 'transfers', unnest(['direction', 'is_loan']), unnest([direction, CAST(is_loan AS VARCHAR)]) FROM transfers), c AS (SELECT 'documents', unnest(['lang', 'source']), unnest([lang, source]) FROM documents), d AS (SELECT 'events', 'event_type', event_type FROM events)
    SELECT t AS "table", dimension, value, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d) GROUP BY 1, 2, 3""",
)
def dimension_counts(spark, sf_dir):
    """Rows of four tables by each of their dimensions."""
    parts = {
        "claims": (b.claims(spark, sf_dir), ["source", "rumor_stage", "direction"]),
        "transfers": (b.transfers(spark, sf_dir), ["direction", "is_loan"]),
        "documents": (table(spark, sf_dir, "documents"), ["lang", "source"]),
        "events": (table(spark, sf_dir, "events"), ["event_type"]),
    }
    out = None
    for name, (df, dims) in parts.items():
        one = ru.counts_by(df, dims).select(F.lit(name).alias("table"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "briefing_signals",
    f"""WITH {_SIGNALS}, r AS (SELECT case_id, club, blended, direct, credibility_score, signal_date FROM sg)
    SELECT 'direct' AS part, case_id, rank FROM (SELECT *, row_number() OVER (ORDER BY abs(blended) DESC, credibility_score DESC, signal_date DESC, case_id) AS rank FROM r WHERE direct) WHERE rank <= 8
    UNION ALL SELECT 'consensus', case_id, rank FROM (SELECT *, row_number() OVER (ORDER BY credibility_score DESC, abs(blended) DESC, case_id) AS rank FROM r) WHERE rank <= 5""",
)
def briefing_signals(spark, sf_dir):
    """The eight strongest direct signals and the five best agreed on."""
    s = blended(spark, sf_dir)
    strength = F.abs("blended")
    direct = ru.ranked_top(s.where("direct"), [F.desc(strength), F.desc("credibility_score"), F.desc("signal_date"), F.col("case_id")], 8)
    agreed = ru.ranked_top(s, [F.desc("credibility_score"), F.desc(strength), F.col("case_id")], 5)
    return direct.select(F.lit("direct").alias("part"), "case_id", "rank").unionByName(agreed.select(F.lit("consensus").alias("part"), "case_id", "rank"))


@query(
    "season_signals",
    f"""WITH {_SIGNALS} SELECT season, case_id, rank FROM (SELECT season, case_id, row_number() OVER (PARTITION BY season ORDER BY abs(blended) DESC, signal_date DESC, case_id) AS rank FROM sg) WHERE rank <= 20""",
)
def season_signals(spark, sf_dir):
    """The twenty strongest signals of each season, in order."""
    by = Window.partitionBy("season").orderBy(F.desc(F.abs("blended")), F.desc("signal_date"), "case_id")
    return blended(spark, sf_dir).withColumn("rank", F.row_number().over(by)).where("rank <= 20").select("season", "case_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "signal_views",
    f"""WITH {_SIGNALS}, v AS (SELECT * FROM sg WHERE club = 'BUILDING' AND contains(lower(club || ' ' || player || ' ' || journalist || ' ' || source), 'kim 1'))
    SELECT 'latest' AS sort, case_id, rank FROM (SELECT *, row_number() OVER (ORDER BY signal_date DESC, case_id) AS rank FROM v) WHERE rank <= 25
    UNION ALL SELECT 'strength', case_id, rank FROM (SELECT *, row_number() OVER (ORDER BY abs(blended) DESC, signal_date DESC, case_id) AS rank FROM v) WHERE rank <= 25""",
)
def signal_views(spark, sf_dir):
    """What a reader sees of one club for a search term, by date and by strength."""
    s = blended(spark, sf_dir)
    fields = ["club", "player", "journalist", "source"]
    out = None
    for sort in ("latest", "strength"):
        one = ru.view(s, "BUILDING", "kim 1", fields, sort, 25).select(F.lit(sort).alias("sort"), "case_id", "rank")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "triage",
    f"""WITH {_SIGNALS}, q AS (SELECT case_id, round(CASE WHEN direct THEN 2 ELSE 0 END + credibility_score + prediction_confidence + least(case_id % 8, 5) * 0.08e0 + CASE WHEN rumor_stage IN ('advanced', 'agreed', 'medical', 'official') THEN 0.35e0 ELSE 0 END, 6) AS score FROM sg)
    SELECT case_id, score FROM q ORDER BY score DESC, case_id LIMIT 4""",
)
def triage(spark, sf_dir):
    """The four signals most worth a look."""
    s = blended(spark, sf_dir)
    score = scoring.queue_score(F.col("direct"), F.col("credibility_score"), F.col("prediction_confidence"), (F.col("case_id") % 8).cast("double"), F.col("rumor_stage"))
    return s.select("case_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "case_id").limit(4)


@query(
    "headline_cards",
    f"""WITH {_SIGNALS}, {_SCORED}, {_JUDGED}
    SELECT 'strongest' AS card, CAST(arg_max(case_id, (abs(blended), -case_id)) AS VARCHAR) AS value FROM sg WHERE direct
    UNION ALL SELECT 'best_reporter', journalist FROM (SELECT journalist, (count_if(matched) + 2.5) / (count(*) + 5) AS rate, count(*) AS n FROM judged GROUP BY 1 ORDER BY rate DESC, n DESC, journalist LIMIT 1)
    UNION ALL SELECT 'best_deal', CAST(arg_max(deal_id, (indicator, -deal_id)) AS VARCHAR) FROM ti UNION ALL SELECT 'latest', CAST(CAST(max(published_at) AS DATE) AS VARCHAR) FROM judged""",
)
def headline_cards(spark, sf_dir):
    """One value a card: the strongest signal, the best reporter, the best deal, the latest day."""
    top = lambda df, value, order: df.agg(F.max_by(value, F.struct(*order)).cast("string").alias("value"))
    s, claims = blended(spark, sf_dir).where("direct"), judged_claims(spark, sf_dir)
    reporters = claims.groupBy("journalist").agg(scoring.smoothed(F.count_if("matched"), F.count(F.lit(1)), 0.5).alias("rate"), F.count(F.lit(1)).alias("n"))
    cards = {
        "strongest": top(s, "case_id", [F.abs("blended"), -F.col("case_id")]),
        "best_reporter": reporters.agg(F.min_by("journalist", F.struct(-F.col("rate"), -F.col("n"), "journalist")).alias("value")),
        "best_deal": top(scored_moves(spark, sf_dir), "deal_id", [F.col("indicator"), -F.col("deal_id")]),
        "latest": claims.agg(F.date_format(F.max("published_at"), "yyyy-MM-dd").alias("value")),
    }
    out = None
    for name, df in cards.items():
        one = df.select(F.lit(name).alias("card"), "value")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "linked_watchlist",
    f"""WITH {_SIGNALS}, {TRANSFERS}, w AS (SELECT club, player, arg_max(case_id, (signal_date, case_id)) AS case_id, max(signal_date) AS day, count(*) AS n FROM sg GROUP BY 1, 2),
    m AS (SELECT 'player ' || (player_id % 60) AS player, deal_id, line, date, market_value_eur, direction FROM transfers),
    l AS (SELECT w.club, w.player, deal_id, line, round(0.55e0 + greatest(0, 0.17e0 - least(abs(date_diff('day', date, day)), 365) / 365.0e0 * 0.17e0), 6) AS score, market_value_eur FROM w JOIN m USING (player)),
    b AS (SELECT club, player, deal_id, score FROM (SELECT *, row_number() OVER (PARTITION BY club, player ORDER BY score DESC, deal_id, line, market_value_eur) AS r FROM l) WHERE r = 1)
    SELECT w.club, w.player, w.case_id, w.n, b.deal_id, b.score FROM w LEFT JOIN b USING (club, player)""",
)
def linked_watchlist(spark, sf_dir):
    """The latest signal of each club and player with details and the confirmed move that fits best, if any."""
    s = blended(spark, sf_dir)
    w = s.groupBy("club", "player").agg(F.max_by("case_id", F.struct("signal_date", "case_id")).alias("case_id"), F.max("signal_date").alias("day"), F.count(F.lit(1)).alias("n"))
    moves = b.transfers(spark, sf_dir).select(F.concat(F.lit("player "), F.col("player_id") % 60).alias("player"), "deal_id", "line", "date", "market_value_eur")
    return ru.with_best_link(w, moves).select("club", "player", "case_id", "n", "deal_id", "score")
