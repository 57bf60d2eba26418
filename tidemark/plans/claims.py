"""Queries over claims: matching, reputation, credibility."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import matching as mt
from tidemark.sources import bindings as b
from tidemark.sources.tables import table

from .registry import query
from .sql_bindings import CLAIMS, TRANSFERS


def moves_and_claims(spark, sf_dir):
    """Line items as moves of a supplier's club, and each order's first line item as a claim about one, told with errors."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    # Merged, so that rows lie in even parts, whatever the files are.
    rows = l.join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.concat(F.lit("Pat Surname"), F.col("o_custkey"))
    kind = F.when(F.col("l_returnflag") == "A", "loan").otherwise("permanent")
    way = F.when(F.col("l_returnflag") == "R", "out").otherwise("in")
    date, club = F.to_date("l_shipdate"), F.concat(F.lit("Club "), F.col("l_suppkey"))
    move_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    moves = rows.select(move_id.alias("move_id"), name.alias("m_player"), club.alias("club"), dates.season(date).alias("season"), date.alias("m_date"), way.alias("m_direction"), kind.alias("m_kind"), (F.col("l_returnflag") == "A").alias("m_loan"), F.col("l_extendedprice").alias("m_fee"))
    k = F.col("l_orderkey")
    told = F.when(k % 4 == 1, F.concat(F.lit("P Surname"), F.col("o_custkey"))).when(k % 4 == 2, F.concat(F.lit("Surname"), F.col("o_custkey"), F.lit(" Pat Jr"))).when(k % 4 == 3, "Someone Else").otherwise(name)
    published = F.date_sub(date, (k % 40).cast("int"))
    claims = rows.where("l_linenumber = 1").select(
        move_id.alias("claim_id"), told.alias("player"), club.alias("club"), dates.season(published).alias("season"), published.alias("published"), F.when(k % 5 == 0, "unclear").when(k % 7 == 0, "in").otherwise(way).alias("direction"), F.when(k % 6 == 0, "unclear").otherwise(kind).alias("kind"), (F.col("l_extendedprice") * (1 + (k % 5) / 10)).alias("fee")
    )
    return claims, moves


_SEASON = "CAST(year({d}) - CAST(month({d}) < 7 AS INTEGER) AS VARCHAR) || '-' || lpad(CAST((year({d}) - CAST(month({d}) < 7 AS INTEGER) + 1) % 100 AS VARCHAR), 2, '0')"
_MATCHES = f"""
b0 AS (SELECT *, l_orderkey AS k, CAST(l_shipdate AS DATE) AS d, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS id, 'Pat Surname' || o_custkey AS name, 'Club ' || l_suppkey AS club,
  CASE WHEN l_returnflag = 'R' THEN 'out' ELSE 'in' END AS way, CASE WHEN l_returnflag = 'A' THEN 'loan' ELSE 'permanent' END AS typ FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cl AS (SELECT id AS claim_id, o_custkey, k % 4 AS told, club, CAST(d - CAST(k % 40 AS INTEGER) AS DATE) AS published, CASE WHEN k % 5 = 0 THEN 'unclear' WHEN k % 7 = 0 THEN 'in' ELSE way END AS direction, CASE WHEN k % 6 = 0 THEN 'unclear' ELSE typ END AS kind, l_extendedprice * (1 + (k % 5) / 10.0e0) AS fee FROM b0 WHERE l_linenumber = 1),
c2 AS (SELECT *, {_SEASON.format(d='published')} AS season FROM cl), mv AS (SELECT *, {_SEASON.format(d='d')} AS season FROM b0),
pr AS (SELECT claim_id, id AS move_id, CASE WHEN told = 3 OR c2.o_custkey <> mv.o_custkey THEN 0 ELSE told + 1 END AS sig, abs(date_diff('day', published, d)) AS gap, direction, way, kind, typ, l_returnflag = 'A' AS loan,
  1 - abs(fee - l_extendedprice) / greatest(fee, l_extendedprice) AS f FROM c2 JOIN mv USING (club, season)),
sc AS (SELECT *, round(CASE sig WHEN 1 THEN 0.45e0 WHEN 2 THEN 0.25e0 WHEN 3 THEN 0.15e0 ELSE 0 END + 0.3e0 + CASE WHEN gap <= 7 THEN 0.1e0 WHEN gap <= 30 THEN 0.08e0 WHEN gap <= 90 THEN 0.05e0 WHEN gap <= 180 THEN 0.02e0 ELSE 0 END
  + CASE WHEN direction = 'unclear' THEN 0 WHEN direction = way THEN 0.08e0 ELSE -0.12e0 END + CASE WHEN kind = 'unclear' THEN 0 WHEN kind = typ THEN 0.05e0 ELSE -0.05e0 END + CASE WHEN f >= 0.8 THEN 0.08e0 WHEN f >= 0.5 THEN 0.04e0 ELSE 0 END, 6) AS score,
  concat_ws('|', CASE sig WHEN 1 THEN 'exact_player' WHEN 2 THEN 'surname_player' WHEN 3 THEN 'fuzzy_player' END, 'exact_club', 'season_match', CASE WHEN gap <= 180 THEN 'date_near' END,
  CASE WHEN direction <> 'unclear' THEN CASE WHEN direction = way THEN 'direction_match' ELSE 'direction_conflict' END END, CASE WHEN kind <> 'unclear' THEN CASE WHEN kind = typ THEN 'type_match' ELSE 'type_conflict' END END,
  CASE WHEN f >= 0.8 THEN 'fee_close' WHEN f >= 0.5 THEN 'fee_similar' END) AS reasons FROM pr),
rk AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt, count(*) OVER (PARTITION BY claim_id) AS candidates FROM sc WINDOW w AS (PARTITION BY claim_id ORDER BY score DESC, move_id)),
best AS (SELECT c2.claim_id, CASE WHEN rk.claim_id IS NULL THEN 'no_candidates' WHEN sig = 0 THEN 'missing_player_signal' WHEN score < 0.45 THEN 'score_below_threshold' ELSE 'matched' END AS status, move_id, score, reasons, coalesce(round(score - nxt, 6) < 0.07, false) AS amb, coalesce(candidates, 0) AS candidates
  FROM c2 LEFT JOIN rk ON c2.claim_id = rk.claim_id AND r = 1)
"""


@query("claim_best_match", f"WITH {_MATCHES} SELECT claim_id, status, candidates, CASE WHEN status = 'matched' THEN move_id END AS move_id, CASE WHEN status = 'matched' THEN score ELSE 0 END AS score, CASE WHEN status = 'matched' THEN reasons END AS reasons, CAST(status = 'matched' AND amb AS INTEGER) AS ambiguous FROM best")
def claim_best_match(spark, sf_dir):
    return mt.best_matches(*moves_and_claims(spark, sf_dir))


def open_claims(spark, sf_dir):
    """The same claims, some without a club or a season, with another club, or about something else."""
    claims, moves = moves_and_claims(spark, sf_dir)
    k = F.split_part("claim_id", F.lit("-"), F.lit(1)).cast("bigint")
    other = F.concat(F.lit("Club "), k % 97)
    more = {
        "clubs": F.when(k % 9 == 0, F.array(other, "club")).when(k % 9 == 1, F.array(other)),
        "related": k % 10 != 3,
        "club": F.when(k % 16 == 5, "").when(k % 16 == 6, "Nowhere").otherwise(F.col("club")),
        "season": F.when(k % 13 == 4, "").when(k % 13 == 5, "1901-02").otherwise(F.col("season")),
    }
    return claims.withColumns(more), moves


_OPEN = f"""
oc AS (SELECT c2.* REPLACE (CASE WHEN k % 16 = 5 THEN NULL WHEN k % 16 = 6 THEN 'Nowhere' ELSE club END AS club,
    CASE WHEN k % 13 = 4 THEN NULL WHEN k % 13 = 5 THEN '1901-02' ELSE season END AS season),
  k % 10 <> 3 AS related,
  CASE WHEN k % 9 = 0 THEN ['Club ' || (k % 97), club] WHEN k % 9 = 1 THEN ['Club ' || (k % 97)] ELSE [] END AS clubs
  FROM (SELECT *, CAST(split_part(claim_id, '-', 1) AS BIGINT) AS k, row_number() OVER () AS rn FROM c2) c2),
mw AS (SELECT *, row_number() OVER () AS mn FROM mv),
ck AS (SELECT DISTINCT rn, season, unnest(list_filter(list_append(clubs, club), lambda x: x IS NOT NULL)) AS k_club FROM oc WHERE related),
own AS (SELECT ck.rn, mn FROM ck JOIN mw ON mw.club = k_club AND mw.season = ck.season WHERE ck.season IS NOT NULL
  UNION ALL SELECT ck.rn, mn FROM ck JOIN mw ON mw.club = k_club WHERE ck.season IS NULL),
rest AS (SELECT rn FROM oc WHERE related AND club IS NULL AND rn NOT IN (SELECT rn FROM own)),
pool AS (SELECT * FROM own UNION ALL SELECT rn, mn FROM rest, mw)"""


@query(
    "candidate_pools",
    f"""WITH {_MATCHES}, {_OPEN}
    SELECT claim_id, coalesce(n, 0) AS candidates,
      CASE WHEN NOT related THEN 'unrelated' WHEN n IS NULL THEN 'none' WHEN rn IN (SELECT rn FROM rest) THEN 'all' ELSE 'clubs' END AS pool
    FROM oc LEFT JOIN (SELECT rn, count(*) AS n FROM pool GROUP BY 1) USING (rn)""",
)
def candidate_pools(spark, sf_dir):
    """How many moves each claim may be about, and why."""
    return mt.candidate_pools(*open_claims(spark, sf_dir))


@query(
    "pooled_matches",
    f"""WITH {_MATCHES}, {_OPEN},
    prs AS (SELECT oc.claim_id, id AS move_id, CASE WHEN told = 3 OR oc.o_custkey <> mv.o_custkey THEN 0 ELSE told + 1 END AS sig, oc.club = mv.club AS same_club,
      oc.club IS NOT NULL AND contains(lower(mv.club), lower(oc.club)) AS alias, oc.season = mv.season AS same_season, abs(date_diff('day', published, d)) AS gap,
      direction, way, kind, typ, l_returnflag = 'A' AS loan, 1 - abs(fee - l_extendedprice) / greatest(fee, l_extendedprice) AS f FROM oc JOIN pool USING (rn) JOIN mw mv USING (mn)),
    scs AS (SELECT claim_id, move_id, sig, round(CASE sig WHEN 1 THEN 0.45e0 WHEN 2 THEN 0.25e0 WHEN 3 THEN 0.15e0 ELSE 0 END + CASE WHEN same_club THEN 0.2e0 WHEN alias THEN 0.1e0 ELSE 0 END + CASE WHEN same_season THEN 0.1e0 ELSE 0 END
      + CASE WHEN gap <= 7 THEN 0.1e0 WHEN gap <= 30 THEN 0.08e0 WHEN gap <= 90 THEN 0.05e0 WHEN gap <= 180 THEN 0.02e0 ELSE 0 END + CASE WHEN direction = 'unclear' THEN 0 WHEN direction = way THEN 0.08e0 ELSE -0.12e0 END
      + CASE WHEN kind = 'unclear' THEN 0 WHEN kind = typ THEN 0.05e0 WHEN kind = 'loan' AND loan THEN 0.03e0 ELSE -0.05e0 END + CASE WHEN f >= 0.8 THEN 0.08e0 WHEN f >= 0.5 THEN 0.04e0 ELSE 0 END, 6) AS score FROM prs),
    rks AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt FROM scs WINDOW w AS (PARTITION BY claim_id ORDER BY score DESC, move_id)),
    st AS (SELECT oc.claim_id, move_id, score, nxt, CASE WHEN NOT related THEN 'not_transfer_related' WHEN rks.claim_id IS NULL THEN 'no_candidates' WHEN sig = 0 THEN 'missing_player_signal' WHEN score < 0.45 THEN 'score_below_threshold' ELSE 'matched' END AS status
      FROM oc LEFT JOIN rks ON oc.claim_id = rks.claim_id AND r = 1)
    SELECT claim_id, status, CASE WHEN status = 'matched' THEN move_id END AS move_id, CASE WHEN status = 'matched' THEN score ELSE 0 END AS score,
      CAST(status = 'matched' AND coalesce(round(score - nxt, 6) < 0.07, false) AS INTEGER) AS ambiguous FROM st""",
)
def pooled_matches(spark, sf_dir):
    """The best move of each claim's pool, whatever the claim names."""
    return mt.best_matches(*open_claims(spark, sf_dir)).select("claim_id", "status", "move_id", "score", "ambiguous")


@query("match_reason_counts", f"WITH {_MATCHES} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, '|')) AS reason FROM best WHERE status = 'matched') GROUP BY 1")
def match_reason_counts(spark, sf_dir):
    found = mt.best_matches(*moves_and_claims(spark, sf_dir)).where("reasons is not null")
    return found.select(F.explode(F.split("reasons", r"\|")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "nearest_date_resolution",
    f"""WITH {TRANSFERS}, t AS (SELECT *, row_number() OVER () AS z FROM transfers)
    SELECT article_id, deal_id, line, days FROM (SELECT o_orderkey AS article_id, deal_id, line, abs(date_diff('day', CAST(o_orderdate AS DATE), date)) AS days,
      row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(date_diff('day', CAST(o_orderdate AS DATE), date)), deal_id, line, wage_eur_annual) AS r FROM orders JOIN t ON o_custkey = player_id) WHERE r = 1""",
)
def nearest_date_resolution(spark, sf_dir):
    """Each order's nearest move of the same customer."""
    articles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_custkey").alias("player_id"), F.to_date("o_orderdate").alias("published"))
    moves = b.transfers(spark, sf_dir).select("player_id", "date", "deal_id", "line", "wage_eur_annual")
    found = mt.nearest(articles, moves, "player_id", "published", "date", ["deal_id", "line", "wage_eur_annual"]).where("deal_id is not null")
    return found.select("article_id", "deal_id", "line", F.abs(F.datediff("date", "published")).cast("bigint").alias("days"))


@query(
    "earliest_credible_event",
    f"""WITH {TRANSFERS}, n AS (SELECT o_custkey AS player_id, CAST(min(o_orderdate) AS DATE) AS first_seen, count(*) AS n_news FROM orders WHERE o_totalprice >= 200000 GROUP BY 1)
    SELECT player_id, event_date, date_source, count(*) AS n_moves FROM (SELECT t.player_id, coalesce(first_seen, t.date) AS event_date,
      CASE WHEN first_seen IS NULL THEN CASE WHEN strftime(t.date, '%m-%d') = '07-01' THEN 'proxy' ELSE 'exact' END ELSE 'earliest_news' END AS date_source FROM transfers t LEFT JOIN n USING (player_id)) GROUP BY 1, 2, 3""",
)
def earliest_credible_event(spark, sf_dir):
    """The first credible news of a player replaces the date of the move."""
    news = table(spark, sf_dir, "orders").where("o_totalprice >= 200000").groupBy(F.col("o_custkey").alias("player_id")).agg(F.to_date(F.min("o_orderdate")).alias("first_seen"))
    t = b.transfers(spark, sf_dir).select("player_id", "date").join(news, "player_id", "left")
    origin = F.when(F.col("first_seen").isNotNull(), "earliest_news").when(F.date_format("date", "MM-dd") == "07-01", "proxy").otherwise("exact")
    return t.groupBy("player_id", F.coalesce("first_seen", "date").alias("event_date"), origin.alias("date_source")).agg(F.count(F.lit(1)).alias("n_moves"))


@query(
    "loan_return_pairs",
    f"""WITH {TRANSFERS}, mv AS (SELECT deal_id || '-' || line || '-' || CAST(round(wage_eur_annual) AS BIGINT) AS base, player_id, date, CASE WHEN line % 2 = 1 THEN from_id ELSE to_id END AS from_id, CASE WHEN line % 2 = 1 THEN to_id ELSE from_id END AS to_id, transfer_fee_eur AS fee FROM transfers),
    u AS (SELECT player_id, date, from_id, to_id, fee, base || '-' || row_number() OVER (PARTITION BY base ORDER BY player_id, date, from_id, to_id, fee) AS move_id FROM mv),
    f AS (SELECT * FROM u WHERE fee = 0 AND from_id <> to_id),
    p AS (SELECT a.move_id, b.move_id AS prior_id, date_diff('day', b.date, a.date) AS gap, row_number() OVER (PARTITION BY a.move_id ORDER BY b.date DESC, b.from_id DESC, b.to_id DESC, b.move_id DESC) AS r
      FROM f a JOIN f b ON a.player_id = b.player_id AND a.from_id = b.to_id AND a.to_id = b.from_id AND (b.date, b.from_id, b.to_id, b.move_id) < (a.date, a.from_id, a.to_id, a.move_id)),
    q AS (SELECT * FROM p WHERE r = 1 AND gap <= 400)
    SELECT move_id, CASE WHEN move_id IN (SELECT move_id FROM q) THEN 'loan_return' WHEN move_id IN (SELECT prior_id FROM q) THEN 'loan' ELSE 'permanent' END AS kind FROM u""",
)
def loan_return_pairs(spark, sf_dir):
    t = b.transfers(spark, sf_dir)
    odd = F.col("line") % 2 == 1
    moves = t.select(F.concat_ws("-", "deal_id", "line", F.round("wage_eur_annual").cast("bigint")).alias("move_id"), "player_id", "date", F.when(odd, F.col("from_id")).otherwise(F.col("to_id")).alias("from_id"), F.when(odd, F.col("to_id")).otherwise(F.col("from_id")).alias("to_id"), F.col("transfer_fee_eur").alias("fee"))
    # Moves that share an id are told apart by a number.
    turn = F.row_number().over(Window.partitionBy("move_id").orderBy("player_id", "date", "from_id", "to_id", "fee"))
    return mt.loan_kinds(moves.withColumn("move_id", F.concat_ws("-", "move_id", turn))).select("move_id", "kind")


def judged_claims(spark, sf_dir):
    """Claims with a match outcome: signups and purchases are confirmed."""
    c = b.claims(spark, sf_dir)
    return c.withColumns({"matched": F.col("rumor_stage").isin("agreed", "official"), "match_score": F.least(F.col("fee") / 100, F.lit(1.0))})


_JUDGED = f"{CLAIMS}, judged AS (SELECT *, rumor_stage IN ('agreed', 'official') AS matched, least(fee / 100, 1.0e0) AS match_score FROM claims)"
_REP = f"""{_JUDGED}, rep AS (SELECT 'source' AS grain, source, NULL AS journalist, NULL AS club, count(*) AS n_claims, count_if(matched) AS n_matched, avg(match_score) AS avg_match_score FROM judged GROUP BY source
  UNION ALL SELECT 'journalist', NULL, journalist, NULL, count(*), count_if(matched), avg(match_score) FROM judged GROUP BY journalist
  UNION ALL SELECT 'club_journalist', NULL, journalist, club, count(*), count_if(matched), avg(match_score) FROM judged GROUP BY club, journalist)"""


@query("reputation_grouping_sets", f"WITH {_REP} SELECT grain, source, journalist, club, n_claims, n_matched, round(n_matched / n_claims, 6) AS match_rate, round((n_matched + 2.5) / (n_claims + 5), 6) AS smoothed_rate, round(avg_match_score, 6) AS avg_match_score FROM rep")
def reputation_grouping_sets(spark, sf_dir):
    return mt.reputation(judged_claims(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("match_rate", "smoothed_rate", "avg_match_score")})


_PRIOR = "CASE WHEN source = 'outlet 1' THEN 0.95e0 WHEN source = 'outlet 2' THEN 0.84e0 WHEN source = 'outlet 3' THEN 0.25e0 ELSE 0.5e0 END"
PRIORS = {"outlet 1": 0.95, "outlet 2": 0.84, "outlet 3": 0.25}


@query(
    "credibility_scores",
    f"""WITH {_REP}, j AS (SELECT c.*, {_PRIOR.replace('source', 'c.source')} AS prior, s.n_claims AS sn, s.n_matched AS sm, r.n_claims AS jn, r.n_matched AS jm, k.n_claims AS cn, k.n_matched AS cm, k.avg_match_score AS ca FROM judged c
      JOIN rep s ON s.grain = 'source' AND s.source = c.source JOIN rep r ON r.grain = 'journalist' AND r.journalist = c.journalist JOIN rep k ON k.grain = 'club_journalist' AND k.club = c.club AND k.journalist = c.journalist),
    t AS (SELECT *, 0.7e0 * (jm + prior * 5) / (jn + 5) + 0.3e0 * prior AS reporter FROM j),
    u AS (SELECT *, 0.25e0 * prior + 0.20e0 * reporter + 0.20e0 * ((sm + prior * 5) / (sn + 5) + (jm + prior * 5) / (jn + 5)) / 2 + 0.10e0 * (0.6e0 * (cm + reporter * 5) / (cn + 5) + 0.4e0 * ca)
      + 0.15e0 * CASE rumor_stage WHEN 'official' THEN 0.95e0 WHEN 'agreed' THEN 0.82e0 WHEN 'talks' THEN 0.55e0 WHEN 'linked' THEN 0.48e0 ELSE 0.4e0 END + 0.05e0 * CASE WHEN rumor_stage = 'official' THEN 0.9e0 ELSE 0.65e0 END
      + 0.05e0 * CASE WHEN NOT matched THEN 0.5e0 WHEN claim_id % 100 <= 3 THEN 0.95e0 WHEN claim_id % 100 <= 7 THEN 0.85e0 WHEN claim_id % 100 <= 30 THEN 0.65e0 WHEN claim_id % 100 <= 90 THEN 0.45e0 ELSE 0.25e0 END AS raw FROM t)
    SELECT claim_id, round(least(1, CASE WHEN rumor_stage = 'unclear' THEN least(raw * 0.35e0, 0.2e0) ELSE raw END * CASE WHEN claim_id % 10 = 0 THEN 0.9e0 ELSE 1 END), 4) AS credibility FROM u""",
)
def credibility_scores(spark, sf_dir):
    c = judged_claims(spark, sf_dir)
    claims = c.withColumns({"article_kind": F.when(F.col("rumor_stage") == "official", "official").otherwise("report"), "days": F.when(F.col("matched"), F.col("claim_id") % 100), "related": F.col("rumor_stage") != "unclear", "ambiguous": F.col("claim_id") % 10 == 0})
    prior = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PRIORS.items() for x in kv)), F.col("source")), F.lit(0.5))
    return mt.credibility(claims, mt.reputation(c), prior).select("claim_id", F.round("credibility", 4).alias("credibility"))


@query("history_merge", f"WITH {CLAIMS} SELECT claim_id, journalist, CASE WHEN published_at < TIMESTAMP '2024-01-16' THEN 'history' ELSE 'live' END AS origin FROM claims")
def history_merge(spark, sf_dir):
    """All claims: history up to a date, then the live ones, which begin three days earlier and hold claims without a time."""
    c = b.claims(spark, sf_dir).select("claim_id", "journalist", "published_at")
    history, live = c.where("published_at < timestamp'2024-01-16'"), c.where("published_at is null or published_at >= timestamp'2024-01-13'")
    return mt.first_wins([("history", history), ("live", live)], "claim_id").drop("published_at")


@query("leaderboard", f"WITH {_REP} SELECT journalist, n_claims, n_matched, round(n_matched / n_claims, 4) AS match_rate, round((n_matched + 2.5) / (n_claims + 5), 4) AS smoothed_rate, round(avg_match_score, 4) AS avg_match_score FROM rep WHERE grain = 'journalist' AND n_claims >= 2 ORDER BY (n_matched + 2.5) / (n_claims + 5) DESC, avg_match_score DESC, n_claims DESC, journalist LIMIT 12")
def leaderboard(spark, sf_dir):
    """The twelve best reporters."""
    rows = mt.reputation(judged_claims(spark, sf_dir)).where("grain = 'journalist' and n_claims >= 2")
    top = rows.orderBy(F.desc("smoothed_rate"), F.desc("avg_match_score"), F.desc("n_claims"), "journalist").limit(12)
    return top.select("journalist", "n_claims", "n_matched", *(F.round(c, 4).alias(c) for c in ("match_rate", "smoothed_rate", "avg_match_score")))


@query(
    "reporter_profiles",
    f"""WITH {_JUDGED}, a AS (SELECT journalist, count(*) AS n_claims, round(avg(match_score), 4) AS avg_score, max(claim_id) AS latest FROM judged GROUP BY 1),
    k AS (SELECT journalist, club, count(*) AS n FROM judged GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY journalist ORDER BY n DESC, club) AS r FROM k)
    SELECT a.*, c.clubs FROM a JOIN (SELECT journalist, string_agg(club || ':' || n, '|' ORDER BY r) AS clubs FROM t WHERE r <= 6 GROUP BY 1) c USING (journalist)""",
)
def reporter_profiles(spark, sf_dir):
    """Each reporter's six most frequent clubs, claims and scores."""
    c = judged_claims(spark, sf_dir)
    base = c.groupBy("journalist").agg(F.count(F.lit(1)).alias("n_claims"), F.round(F.avg("match_score"), 4).alias("avg_score"), F.max("claim_id").alias("latest"))
    counts = c.groupBy("journalist", "club").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("journalist").orderBy(F.desc("n"), "club"))).where("r <= 6")
    clubs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "club", "n"))), lambda x: F.concat_ws(":", x["club"], x["n"])), "|")
    return base.join(top.groupBy("journalist").agg(clubs.alias("clubs")), "journalist")
