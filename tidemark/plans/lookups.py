"""Queries that read finished tables: bodies from landed pages, ranked impact, best signals of a club, evidence of a player."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates, scoring, text
from tidemark.sources import bindings as b
from tidemark.sources.tables import table

from .registry import query
from .sql_bindings import CLAIMS, PREDICTIONS, TRANSFERS


@query(
    "page_bodies",
    r"""WITH a AS (SELECT doc_id AS article_id, text AS body, doc_id % 250 AS page_id, (doc_id % 10) / 10.0e0 AS confidence FROM documents),
    p AS (SELECT page_id, length(html) AS n FROM pages)
    SELECT article_id, CASE WHEN coalesce(length(body), 0) < 400 AND p.page_id IS NOT NULL THEN 'page' ELSE 'feed' END AS body_from, CASE WHEN coalesce(length(body), 0) < 400 AND p.page_id IS NOT NULL THEN greatest(confidence, 0.82e0) ELSE confidence END AS confidence FROM a LEFT JOIN p USING (page_id)""",
)
def page_bodies(spark, sf_dir):
    """Articles with a body below 400 characters take the main text of their landed page and gain confidence."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    a = d.select(i.alias("article_id"), F.col("text").alias("body"), (i % 250).alias("page_id"), ((i % 10) / 10.0).alias("confidence"))
    pages = table(spark, sf_dir, "pages").select("page_id", text.main_text(F.col("html")).alias("page_text"))
    needs = (F.coalesce(F.char_length("body"), F.lit(0)) < 400) & F.col("page_text").isNotNull()
    return a.join(pages, "page_id", "left").select("article_id", F.when(needs, "page").otherwise("feed").alias("body_from"), F.when(needs, F.greatest("confidence", F.lit(0.82))).otherwise(F.col("confidence")).alias("confidence"))


@query(
    "impact_ranking",
    f"""WITH {TRANSFERS}, s AS (SELECT deal_id, line, player_id, CAST(year(date) AS INTEGER) AS season_year, transfer_fee_eur, market_value_eur, row_number() OVER (PARTITION BY year(date), direction ORDER BY transfer_fee_eur - market_value_eur DESC, deal_id, line, player_id, market_value_eur) AS rank, direction FROM transfers)
    SELECT season_year, direction, rank, deal_id, line, round(transfer_fee_eur - market_value_eur, 2) AS gap FROM s WHERE rank <= 5""",
)
def impact_ranking(spark, sf_dir):
    """The five moves of a year and direction with the largest fee above value."""
    gap = F.col("transfer_fee_eur") - F.col("market_value_eur")
    t = b.transfers(spark, sf_dir).withColumns({"season_year": F.year("date"), "gap": gap})
    by = Window.partitionBy("season_year", "direction").orderBy(F.desc("gap"), "deal_id", "line", "player_id", "market_value_eur")
    return t.withColumn("rank", F.row_number().over(by)).where("rank <= 5").select("season_year", "direction", F.col("rank").cast("bigint").alias("rank"), "deal_id", "line", F.round("gap", 2).alias("gap"))


_BLEND = "round(greatest(-1, least(1, 0.45 * (prob_positive - prob_negative) + 0.20e0 * CASE direction WHEN 'in' THEN 1 WHEN 'out' THEN -1 ELSE 0 END * transfer_indicator + 0.30e0 * (credibility_score - 0.5) + 0.20e0 * (rumor_stage_score - 0.5) + 0.20e0 * (stock_context_indicator - 0.5))) * 100, 1)"


@query("club_signals", f"WITH {PREDICTIONS}, s AS (SELECT club, case_id, {_BLEND} AS blended FROM predictions) SELECT club, case_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY club ORDER BY abs(blended) DESC, case_id) AS rank FROM s) WHERE rank <= 5")
def club_signals(spark, sf_dir):
    """The five strongest signals of each club."""
    c = F.col
    score = scoring.blended(c("prob_positive"), c("prob_negative"), c("direction"), c("transfer_indicator"), c("credibility_score"), c("rumor_stage_score"), c("stock_context_indicator"))
    s = b.predictions(spark, sf_dir).withColumn("blended", F.round(score, 1))
    k = F.row_number().over(Window.partitionBy("club").orderBy(F.desc(F.abs("blended")), "case_id"))
    return s.withColumn("rank", k).where("rank <= 5").select("club", "case_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "evidence_articles",
    f"""WITH {CLAIMS}, d AS (SELECT player, source, regexp_replace(lower(regexp_replace(title, '^(.*) - .*$', '\\1')), '[^a-z0-9]+', ' ', 'g') AS fp, max(claim_id) AS claim_id FROM claims GROUP BY 1, 2, 3)
    SELECT player, claim_id, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY claim_id DESC) AS rank FROM d) WHERE rank <= 5""",
)
def evidence_articles(spark, sf_dir):
    """The five latest articles of a player, one per headline and outlet."""
    c = b.claims(spark, sf_dir).withColumn("fp", text.fingerprint(F.col("title")))
    one = c.groupBy("player", "source", "fp").agg(F.max("claim_id").alias("claim_id"))
    k = F.row_number().over(Window.partitionBy("player").orderBy(F.desc("claim_id")))
    return one.withColumn("rank", k).where("rank <= 5").select("player", "claim_id", "source", F.col("rank").cast("bigint").alias("rank"))


@query(
    "season_codes",
    """WITH s AS (SELECT DISTINCT CAST(year(o_orderdate) - CAST(month(o_orderdate) < 7 AS INTEGER) AS INTEGER) AS y FROM orders)
    SELECT y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season, y AS start, make_date(y, 7, 1) AS summer, make_date(y + 1, 1, 1) AS winter FROM s""",
)
def season_codes(spark, sf_dir):
    """Seasons of the orders with their starts and window dates."""
    s = table(spark, sf_dir, "orders").select(dates.season(F.to_date("o_orderdate")).alias("season")).distinct()
    window = lambda w: dates.window_proxy(F.col("season"), F.lit(w))
    return s.select("season", dates.season_start(F.col("season")).alias("start"), window("summer").alias("summer"), window("winter").alias("winter"))
