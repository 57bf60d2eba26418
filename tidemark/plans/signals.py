"""Queries over clusters of coverage, the graph, and the audit of data quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates, scoring
from tidemark.operators import clusters as cs
from tidemark.operators import graph, quality
from tidemark.sources import bindings as b
from tidemark.sources.tables import table

from .registry import query
from .sql_bindings import CLAIMS, PREDICTIONS

AS_OF = "2024-02-05 00:00:00"


def covered(spark, sf_dir):
    c = b.claims(spark, sf_dir)
    return c.withColumns({"credibility": (F.col("claim_id") % 97) / 96.0, "stage_score": scoring.lookup(F.col("rumor_stage"), scoring.STAGE_SCORES, 0.4)})


_COVERED = f"""{CLAIMS}, cov AS (SELECT *, (claim_id % 97) / 96.0e0 AS credibility, CASE rumor_stage WHEN 'official' THEN 0.95e0 WHEN 'agreed' THEN 0.82e0 WHEN 'talks' THEN 0.55e0 WHEN 'linked' THEN 0.48e0 ELSE 0.4e0 END AS stage_score FROM claims)"""
_CLUSTERS = f"""{_COVERED}, g0 AS (SELECT *, published_at - lag(published_at) OVER w AS gap FROM cov WINDOW w AS (PARTITION BY club, player ORDER BY published_at, claim_id)),
g1 AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 2 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY club, player ORDER BY published_at, claim_id) AS cluster_no FROM g0),
cl AS (SELECT * EXCLUDE (gap) FROM g1 QUALIFY max(CAST(prediction_scope = 'direct' AS INTEGER)) OVER (PARTITION BY club, player, cluster_no) = 1)"""
GAP = 1  # days; the given events are dense


@query(
    "same_day_groups",
    f"""WITH {CLAIMS} SELECT CAST(published_at AS DATE) AS day, club, player, count(*) AS rumor_count, count(DISTINCT source) AS source_count, round(max(fee), 4) AS max_fee, round(avg(fee) + 1e-9, 4) AS avg_fee, arg_min(rumor_stage, claim_id) AS first_stage,
      array_to_string(list_sort(list(DISTINCT source))[1:5], ' | ') AS sources FROM claims GROUP BY 1, 2, 3""",
)
def same_day_groups(spark, sf_dir):
    c = b.claims(spark, sf_dir).withColumn("day", F.to_date("published_at"))
    keys = ["day", "club", "player"]
    # Five sources of a group are kept before they are gathered.
    first = c.select(*keys, "source").distinct().withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("source"))).where("k <= 5")
    named = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("source")), " | ").alias("sources"))
    groups = c.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rumor_count"),
        F.countDistinct("source").alias("source_count"),
        F.round(F.max("fee"), 4).alias("max_fee"),
        F.round(F.avg("fee") + 1e-9, 4).alias("avg_fee"),
        F.min_by("rumor_stage", "claim_id").alias("first_stage"),
    )
    return groups.join(named.hint("merge"), keys)


@query("gap_clusters", f"WITH {_CLUSTERS} SELECT club, player, cluster_no, count(*) AS n, min(claim_id) AS first_id, max(claim_id) AS last_id FROM cl GROUP BY 1, 2, 3")
def gap_clusters(spark, sf_dir):
    c = cs.gap_clusters(covered(spark, sf_dir), GAP)
    return c.groupBy(*cs.KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("claim_id").alias("first_id"), F.max("claim_id").alias("last_id"))


_SUMMARY = f"""{_CLUSTERS}, f AS (SELECT *, regexp_replace(lower(regexp_replace(title, '^(.*) - .*$', '\\1')), '[^a-z0-9]+', ' ', 'g') AS fp FROM cl),
b0 AS (SELECT club, player, cluster_no, count(*) AS articles, count_if(prediction_scope = 'direct') AS direct_articles, count(DISTINCT source) AS sources, count(DISTINCT fp) AS headlines, max(credibility) AS credibility, max(stage_score) AS stage_score, min(published_at) AS first_seen, max(published_at) AS last_seen FROM f GROUP BY 1, 2, 3),
dv AS (SELECT club, player, cluster_no, direction, count(*) AS n FROM f GROUP BY 1, 2, 3, 4), d AS (SELECT club, player, cluster_no, arg_min(direction, (-n, direction = 'unclear', direction)) AS direction, max(n) / sum(n) AS ds FROM dv GROUP BY 1, 2, 3),
sv AS (SELECT club, player, cluster_no, rumor_stage, count(*) AS n, max(stage_score) AS x FROM f GROUP BY 1, 2, 3, 4), s AS (SELECT club, player, cluster_no, arg_min(rumor_stage, (-(n + x), rumor_stage)) AS stage, max(n) / sum(n) AS ss FROM sv GROUP BY 1, 2, 3),
q AS (SELECT b0.*, direction, stage, round(1e-9 + 0.45 * credibility + 0.25 * stage_score + 0.15e0 * least(1, least(sources, 6) / 4) + 0.15e0 * least(1, headlines / 4), 4) AS event_strength,
  round(1e-9 + 0.30 * ds + 0.25 * ss + 0.20e0 * least(1, least(sources, 6) / 4) + 0.15e0 * direct_articles / articles + 0.10e0 * headlines / articles, 4) AS consensus_score FROM b0 JOIN d USING (club, player, cluster_no) JOIN s USING (club, player, cluster_no)),
summary AS (SELECT *, CASE WHEN event_strength >= 0.68 AND least(sources, 6) >= 3 AND headlines >= 2 AND direct_articles >= 2 THEN 'broad_consensus' WHEN event_strength >= 0.56 AND sources >= 2 AND direct_articles >= 1 THEN 'strong' WHEN event_strength >= 0.44 AND (sources >= 2 OR headlines >= 2) THEN 'developing' ELSE 'thin' END AS tier,
  CASE WHEN consensus_score >= 0.82 THEN 'Broad alignment' WHEN consensus_score >= 0.68 THEN 'Aligned' WHEN consensus_score >= 0.52 THEN 'Developing' ELSE 'Mixed' END AS consensus_label, CAST(floor(epoch(last_seen - first_seen) / 86400) AS BIGINT) AS span_days FROM q)"""
_OUT = "club, player, cluster_no, articles, direct_articles, sources, headlines, direction, stage, event_strength, consensus_score, tier, consensus_label, span_days"


@query("cluster_consensus", f"WITH {_SUMMARY} SELECT {_OUT} FROM summary")
def cluster_consensus(spark, sf_dir):
    return cs.consensus(cs.gap_clusters(covered(spark, sf_dir), GAP)).select(*_OUT.split(", "))


@query(
    "stage_timeline",
    f"""WITH {_CLUSTERS}, seen AS (SELECT club, player, cluster_no, rumor_stage AS stage, count(*) AS articles, count(DISTINCT source) AS sources FROM cl GROUP BY 1, 2, 3, 4)
    SELECT k.club, k.player, k.cluster_no, k.stage, coalesce(articles, 0) AS articles, coalesce(sources, 0) AS sources FROM (SELECT DISTINCT club, player, cluster_no, unnest(['linked', 'talks', 'bid', 'advanced', 'agreed', 'medical', 'official']) AS stage FROM cl) k
    LEFT JOIN seen s ON k.club = s.club AND k.player = s.player AND k.cluster_no = s.cluster_no AND k.stage = s.stage""",
)
def stage_timeline(spark, sf_dir):
    return cs.stage_timeline(cs.gap_clusters(covered(spark, sf_dir), GAP)).drop("last_seen")


@query("watchlist", f"WITH {_SUMMARY} SELECT {_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY club, player ORDER BY cluster_no DESC) AS r FROM summary) WHERE r = 1 AND last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 21 DAY ORDER BY last_seen DESC, club, player LIMIT 10")
def watchlist(spark, sf_dir):
    s = cs.consensus(cs.gap_clusters(covered(spark, sf_dir), GAP))
    return cs.watchlist(s, F.lit(AS_OF).cast("timestamp")).select(*_OUT.split(", "))


@query(
    "source_coverage",
    f"""WITH {_COVERED} SELECT source, count(*) AS n_rows, count(DISTINCT player) AS n_players, round(avg(credibility) + 1e-9, 4) AS avg_credibility, max(claim_id) AS latest FROM cov
    WHERE prediction_scope = 'direct' AND published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 21 DAY GROUP BY source ORDER BY n_rows DESC, source LIMIT 10""",
)
def source_coverage(spark, sf_dir):
    """The ten outlets with most direct rows in the last 21 days."""
    recent = covered(spark, sf_dir).where((F.col("prediction_scope") == "direct") & (F.col("published_at") >= F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 21 DAYS")))
    g = recent.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("player").alias("n_players"), scoring.rounded(F.avg("credibility")).alias("avg_credibility"), F.max("claim_id").alias("latest"))
    return g.orderBy(F.desc("n_rows"), "source").limit(10)


def graph_rows(spark, sf_dir):
    c = b.claims(spark, sf_dir)
    return c.select(
        F.col("claim_id").alias("event_id"),
        "journalist",
        "source",
        "player",
        "club",
        F.col("rumor_stage").alias("stage"),
        F.when(F.col("fee") >= 60, "positive").when(F.col("fee") <= 20, "negative").otherwise("neutral").alias("label"),
        ((F.col("claim_id") % 97) / 96.0).alias("credibility"),
        F.greatest((F.col("claim_id") % 97) / 96.0, (F.col("claim_id") % 53) / 52.0).alias("score"),
        ((F.col("claim_id") % 53) / 52.0).alias("confidence"),
        F.when(F.col("direction") == "in", "buyer").when(F.col("direction") == "out", "seller").alias("role"),
        F.to_date("published_at").alias("day"),
        F.col("title").alias("evidence"),
    )


_GRAPH = f"""{CLAIMS}, gr AS (SELECT claim_id AS event_id, journalist, source, player, club, rumor_stage AS stage, CASE WHEN fee >= 60 THEN 'positive' WHEN fee <= 20 THEN 'negative' ELSE 'neutral' END AS label, (claim_id % 97) / 96.0e0 AS credibility,
  greatest((claim_id % 97) / 96.0e0, (claim_id % 53) / 52.0e0) AS score, (claim_id % 53) / 52.0e0 AS confidence, CASE direction WHEN 'in' THEN 'buyer' WHEN 'out' THEN 'seller' END AS role, CAST(published_at AS DATE) AS day, title AS evidence FROM claims)"""


@query(
    "graph_nodes",
    f"""WITH {_GRAPH}, n AS (SELECT 'reporter' AS type, journalist AS label, credibility AS score FROM gr UNION ALL SELECT 'source', source, credibility FROM gr UNION ALL SELECT 'player', player, score FROM gr UNION ALL SELECT 'club', club, score FROM gr UNION ALL SELECT 'stage', stage, score FROM gr UNION ALL SELECT 'market', label, confidence FROM gr)
    SELECT type || ':' || label AS id, type, label, count(*) AS weight, round(max(score), 6) AS score FROM n GROUP BY type, label""",
)
def graph_nodes(spark, sf_dir):
    return graph.nodes(graph_rows(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    "graph_edges",
    f"""WITH {_GRAPH}, e AS (SELECT 'reporter:' || journalist AS source_id, 'source:' || source AS target_id, 'published_via' AS type, credibility AS score, day, evidence FROM gr UNION ALL SELECT 'source:' || source, 'player:' || player, 'reported_player', credibility, day, evidence FROM gr
      UNION ALL SELECT 'player:' || player, 'club:' || club, 'linked_to_' || coalesce(role, 'club'), score, day, evidence FROM gr UNION ALL SELECT 'player:' || player, 'stage:' || stage, 'rumor_stage', score, day, evidence FROM gr UNION ALL SELECT 'club:' || club, 'market:' || label, 'market_read', confidence, day, evidence FROM gr)
    SELECT source_id, target_id, type, count(*) AS weight, round(max(score), 6) AS score, min(day) AS first_seen, max(day) AS last_seen, array_to_string(list_sort(list(DISTINCT evidence))[1:4], '|') AS evidence FROM e GROUP BY 1, 2, 3""",
)
def graph_edges(spark, sf_dir):
    return graph.edges(graph_rows(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    "graph_timelines",
    f"""WITH {_GRAPH}, l AS (SELECT player, club, stage, row_number() OVER (PARTITION BY player, club ORDER BY day DESC, event_id DESC) AS k FROM gr), t AS (SELECT player, club, string_agg(stage, '|' ORDER BY k DESC) AS stages FROM l WHERE k <= 8 GROUP BY 1, 2)
    SELECT player, club, count(*) AS event_count, min(day) AS first_seen, max(day) AS last_seen, round(avg(credibility) + 1e-9, 4) AS avg_credibility, any_value(stages) AS stages FROM gr JOIN t USING (player, club) GROUP BY 1, 2 ORDER BY last_seen DESC, event_count DESC, player, club LIMIT 20""",
)
def graph_timelines(spark, sf_dir):
    return graph.timelines(graph_rows(spark, sf_dir)).withColumn("avg_credibility", scoring.rounded(F.col("avg_credibility")))


@query(
    "quality_audit",
    f"""WITH {_COVERED}, t AS (SELECT date_diff('day', max(CAST(published_at AS DATE)), DATE '2024-02-05') AS stale, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT journalist) AS people, count(DISTINCT club) AS clubs, avg(least(fee / 100, 1)) AS fit, count_if(prediction_scope = 'direct') / count(*) AS direct,
      count_if(fee / 100 < 0.65) / count(*) AS weak, count_if(published_at > TIMESTAMP '2024-01-30') AS future FROM cov),
    d AS (SELECT 'freshness' AS name, 0.24e0 AS w, CASE WHEN stale <= 2 THEN 1.0e0 WHEN stale <= 7 THEN 0.76e0 WHEN stale <= 14 THEN 0.52e0 WHEN stale <= 30 THEN 0.28e0 ELSE 0.12e0 END AS score FROM t
      UNION ALL SELECT 'sources', 0.18e0, 0.35e0 * least(1, sources / 8) + 0.25e0 * least(1, n / 24) + 0.20e0 * least(1, people / 6) + 0.20e0 FROM t UNION ALL SELECT 'market', 0.18e0, 0.80e0 + 0.20e0 * least(1, clubs / 30) FROM t
      UNION ALL SELECT 'matching', 0.16e0, 0.55e0 * fit + 0.30e0 * direct + 0.15e0 * (1 - weak) FROM t UNION ALL SELECT 'dates', 0.10e0, CASE WHEN future = 0 THEN 1.0e0 ELSE greatest(0.15e0, 1 - least(future, 20) / 20) END FROM t),
    a AS (SELECT name, w, score FROM d UNION ALL SELECT 'overall', 1.0e0, sum(w * score) / sum(w) FROM d)
    SELECT name, round(score, 4) AS score, CASE WHEN score >= 0.82 THEN 'strong' WHEN score >= 0.62 THEN 'usable' WHEN score >= 0.42 THEN 'watch' ELSE 'needs_refresh' END AS status FROM a""",
)
def quality_audit(spark, sf_dir):
    """Five weighted dimensions of the coverage, from one aggregate, and their mean."""
    c = covered(spark, sf_dir)
    t = c.agg(
        F.datediff(F.lit("2024-02-05").cast("date"), F.max(F.to_date("published_at"))).alias("stale"),
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("source").alias("sources"),
        F.countDistinct("journalist").alias("people"),
        F.countDistinct("club").alias("clubs"),
        F.avg(F.least(F.col("fee") / 100, F.lit(1))).alias("fit"),
        F.avg((F.col("prediction_scope") == "direct").cast("int")).alias("direct"),
        F.avg((F.col("fee") / 100 < 0.65).cast("int")).alias("weak"),
        F.count_if(F.col("published_at") > F.lit("2024-01-30").cast("timestamp")).alias("future"),
    )
    share = lambda column, full: F.least(F.lit(1.0), F.col(column) / full)
    dims = {
        "freshness": (0.24, dates.freshness(F.col("stale"))),
        "sources": (0.18, 0.35 * share("sources", 8) + 0.25 * share("n", 24) + 0.20 * share("people", 6) + 0.20),
        "market": (0.18, 0.80 + 0.20 * share("clubs", 30)),
        "matching": (0.16, 0.55 * F.col("fit") + 0.30 * F.col("direct") + 0.15 * (1 - F.col("weak"))),
        "dates": (0.10, F.when(F.col("future") == 0, 1.0).otherwise(F.greatest(F.lit(0.15), 1 - F.least(F.col("future"), F.lit(20)) / 20))),
    }
    overall = sum((w * s for w, s in dims.values()), F.lit(0.0)) / sum(w for w, _ in dims.values())
    rows = [F.struct(F.lit(k).alias("name"), s.cast("double").alias("score")) for k, (_, s) in dims.items()] + [F.struct(F.lit("overall").alias("name"), overall.alias("score"))]
    return t.select(F.inline(F.array(*rows))).select("name", F.round("score", 4).alias("score"), scoring.score_status(F.col("score")).alias("status"))


@query(
    "quality_dimensions",
    f"""WITH {_CLUSTERS}, {PREDICTIONS}, s AS (SELECT date_diff('day', max(CAST(published_at AS DATE)), DATE '2024-01-28') AS stale, count(*) AS rows_n, count(DISTINCT source) AS outlets, count(DISTINCT journalist) AS reporters, count_if(prediction_scope = 'direct') AS direct,
      avg(least(fee / 100, 1)) FILTER (WHERE prediction_scope = 'direct') AS fit, count_if(prediction_scope = 'direct' AND least(fee / 100, 1) < 0.65) AS weak, count_if(CAST(published_at AS DATE) > DATE '2024-01-28') AS future FROM cov),
    k AS (SELECT count(*) AS clusters, sum(a) AS articles, count_if(n >= 2) AS several, count_if(n < 2 OR a < 2) AS thin FROM (SELECT count(*) AS a, count(DISTINCT source) AS n FROM cl GROUP BY club, player, cluster_no)),
    pt AS (SELECT 'NATION_' || c_nationkey AS club, CAST(max(o_orderdate) AS DATE) + CAST(9290 + 2 * c_nationkey AS INTEGER) AS latest_day, count_if(o_orderpriority = '1-URGENT' AND o_totalprice >= 400000) AS markers FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 6 <> 0 GROUP BY c_nationkey),
    m AS (SELECT count(*) AS clubs, count_if(latest_day IS NULL) AS missing, count_if(date_diff('day', latest_day, DATE '2024-01-28') > 14) AS old, coalesce(sum(markers), 0) AS markers FROM (SELECT DISTINCT club FROM cov) LEFT JOIN pt USING (club)),
    te AS (SELECT * FROM predictions WHERE split = 'test'),
    f AS (SELECT avg(f1) AS macro_f1 FROM (SELECT 2 * count_if(actual_label = x AND predicted_label = x) / (count_if(actual_label = x) + count_if(predicted_label = x)) AS f1 FROM te, (SELECT unnest(['negative', 'neutral', 'positive']) AS x) GROUP BY x HAVING count_if(actual_label = x) + count_if(predicted_label = x) > 0)),
    e AS (SELECT count(*) AS tested, coalesce(avg(CAST(actual_label = predicted_label AS INTEGER)), 0) AS accuracy, count_if(actual_label = 'positive') AS positives FROM te),
    d AS (SELECT 'freshness' AS name, 0.24e0 AS w, CASE WHEN stale IS NULL THEN 0e0 WHEN stale <= 2 THEN 1.0e0 WHEN stale <= 7 THEN 0.76e0 WHEN stale <= 14 THEN 0.52e0 WHEN stale <= 30 THEN 0.28e0 ELSE 0.12e0 END AS x, concat_ws('|', CASE WHEN stale IS NULL THEN 'no dates' END, CASE WHEN stale > 7 THEN 'stale signals' END) AS warnings FROM s
      UNION ALL SELECT 'sources', 0.18e0, 0.35e0 * least(1, outlets / 8) + 0.25e0 * least(1, articles / 24) + 0.2e0 * least(1, reporters / 6) + 0.2e0 * several / clusters, concat_ws('|', CASE WHEN clusters = 0 THEN 'no clusters' END, CASE WHEN thin > 0 THEN 'thin clusters' END) FROM s, k
      UNION ALL SELECT 'market', 0.18e0, 0.45e0 * (1 - missing / clubs) + 0.35e0 * (1 - old / clubs) + 0.2e0 * least(1, markers / (clubs * 3)), concat_ws('|', CASE WHEN missing > 0 THEN 'missing paths' END, CASE WHEN old > 0 THEN 'stale paths' END, CASE WHEN markers = 0 THEN 'no markers' END) FROM m
      UNION ALL SELECT 'matching', 0.16e0, 0.55e0 * fit + 0.3e0 * direct / rows_n + 0.15e0 * (1 - weak / direct), concat_ws('|', CASE WHEN weak > 0 THEN 'weak matches' END, CASE WHEN direct / rows_n < 0.5 THEN 'few direct signals' END) FROM s
      UNION ALL SELECT 'model', 0.14e0, 0.35e0 * accuracy + 0.35e0 * coalesce(macro_f1, 0) + 0.2e0 * least(1, tested / 120) + 0.1e0 * least(1, positives / greatest(tested * 0.12e0, 1)), concat_ws('|', CASE WHEN tested < 50 THEN 'small holdout' END, CASE WHEN positives <= greatest(2, tested * 0.08e0) THEN 'sparse positives' END, CASE WHEN coalesce(macro_f1, 0) < 0.4 THEN 'low macro F1' END) FROM e, f
      UNION ALL SELECT 'dates', 0.10e0, CASE WHEN future = 0 THEN 1.0e0 ELSE greatest(0.15e0, 1 - least(future, 20) / 20) END, CASE WHEN future > 0 THEN 'future dates' ELSE '' END FROM s),
    r AS (SELECT name, w, round(x + 1e-9, 4) AS score, warnings FROM d), a AS (SELECT name, score, warnings FROM r UNION ALL SELECT 'overall', round(sum(w * score) + 1e-9, 4), '' FROM r)
    SELECT name, score, warnings, CASE WHEN score >= 0.82 THEN 'strong' WHEN score >= 0.62 THEN 'usable' WHEN score >= 0.42 THEN 'watch' ELSE 'needs_refresh' END AS status FROM a""",
)
def quality_dimensions(spark, sf_dir):
    """Six dimensions of the data: claims, their clusters, paths of nations, and the predictions of the test split."""
    claims = covered(spark, sf_dir)
    clusters = cs.gap_clusters(claims, GAP).groupBy(*cs.KEYS).agg(F.count(F.lit(1)).alias("articles"), F.countDistinct("source").alias("sources"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("c_nationkey % 6 <> 0")
    marked = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") >= 400_000)
    paths = orders.groupBy("c_nationkey").agg(F.max(F.to_date("o_orderdate")).alias("last"), F.count_if(marked).alias("markers"))
    paths = paths.select(F.concat(F.lit("NATION_"), "c_nationkey").alias("club"), F.date_add("last", (9290 + 2 * F.col("c_nationkey")).cast("int")).alias("latest_day"), "markers")
    signals = claims.withColumn("match_score", F.least(F.col("fee") / 100, F.lit(1.0)))
    found = quality.audit(signals, clusters, claims.select("club"), paths, b.predictions(spark, sf_dir).where("split = 'test'"), F.lit("2024-01-28").cast("date"))
    return found.withColumn("warnings", F.array_join("warnings", "|"))
