"""Queries over landed files and imports: tables are written in the formats that the engine ingests and read back as such."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.scoring import rounded
from tidemark.operators import imports as im
from tidemark.sources import bindings as b
from tidemark.sources import sinks, tables
from tidemark.sources.tables import table
from tidemark.storage import shared_dir

from .registry import query
from .sql_bindings import HEADLINES, TRANSFERS


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/landed/{uuid.uuid4().hex}"


_COUNTS = "count(*) AS n, sum(o_orderkey) AS keys, round(sum(o_totalprice), 2) AS prices FROM orders"


@query(
    "landed_tables",
    f"""SELECT 'csv' AS file, {_COUNTS} UNION ALL SELECT 'csv_gzip', {_COUNTS} UNION ALL SELECT 'json_lines', {_COUNTS} UNION ALL SELECT 'runs', {_COUNTS}
    UNION ALL SELECT 'payload', {_COUNTS} UNION ALL SELECT 'bars', count(*), sum(o_orderkey), round(sum(o_totalprice), 2) FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'missing', 0, NULL, NULL""",
)
def landed_tables(spark, sf_dir):
    """Orders written as CSV, gzip CSV, JSON lines (in two goes), run folders, JSON payloads and price bars, and read back."""
    o, at = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), _folder(spark)
    schema = "o_orderkey BIGINT, o_totalprice DOUBLE"
    fields = ["o_orderkey", "o_totalprice"]
    half = F.col("o_orderkey") % 2 == 0
    sinks.write_rows(o, f"{at}/csv", fields)
    sinks.to_fields(o, fields).write.option("compression", "gzip").csv(f"{at}/gzip", header=True)
    sinks.write_json_lines(o.where(half).select(*fields), f"{at}/json")
    sinks.write_json_lines(o.where(~half).select(*fields), f"{at}/json", mode="append")
    sinks.write_run(o.where(half).select(*fields), f"{at}/runs", "first")
    sinks.write_run(o.where(~half).select(*fields), f"{at}/runs", "second")
    sinks.payload(o.select(*fields)).write.text(f"{at}/payload")
    gone = F.when(F.col("o_orderkey") % 5 == 0, "N/D").otherwise(F.col("o_totalprice").cast("string"))
    bars = o.select(F.to_date("o_orderdate").alias("date"), *(F.lit("N/D").alias(c) for c in ("open", "high", "low")), gone.alias("close"), F.col("o_orderkey").alias("volume"))
    bars.write.csv(f"{at}/bars", header=True)
    prices = tables.read_price_bars(spark, f"{at}/bars").select(F.col("volume").alias("o_orderkey"), F.col("close").alias("o_totalprice"))
    read = {
        "csv": tables.read_rows(spark, f"{at}/csv", schema),
        "csv_gzip": tables.read_rows(spark, f"{at}/gzip", schema),
        "json_lines": tables.read_json_lines(spark, f"{at}/json", schema),
        "runs": spark.read.schema(schema + ", run_id STRING").parquet(f"{at}/runs").drop("run_id"),
        "payload": spark.read.text(f"{at}/payload").select(F.from_json("value", schema).alias("v")).select("v.*"),
        "bars": prices,
        "missing": tables.read_price_bars(spark, f"{at}/not_there").select(F.col("volume").alias("o_orderkey"), F.col("close").alias("o_totalprice")),
    }
    out = None
    for name, df in read.items():
        one = df.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("prices")).select(F.lit(name).alias("file"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "landed_feed",
    f"""WITH {HEADLINES}, f AS (SELECT article_id, title, 'Feed ' || (article_id % 7) AS source, date FROM headlines),
    k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY date DESC, 'https://f.example/' || article_id) AS r FROM f
      WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND NOT contains(title, 'match report'))
    SELECT source, count(*) AS n, min(date) AS first_day, max(date) AS last_day FROM k WHERE r <= 200 GROUP BY 1""",
)
def landed_feed(spark, sf_dir):
    """Headlines as feed items with two kinds of tags, read back for a window of dates and words of deals, at most 200 a source."""
    h = b.headlines(spark, sf_dir)
    i = F.col("article_id")
    stamp = F.concat(F.date_format("date", "EEE, dd MMM yyyy"), F.lit(" 00:00:00 GMT"))
    url = F.concat(F.lit("https://f.example/"), i)
    items = h.select(
        "title",
        F.when(i % 2 == 0, url).alias("link"),
        F.when(i % 2 == 1, url).alias("guid"),
        F.when(i % 3 == 0, stamp).alias("pubDate"),
        F.when(i % 3 != 0, F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("published"),
        F.concat(F.lit("Feed "), i % 7).alias("source"),
        F.lit("plain words").alias("description"),
    )
    at = _folder(spark)
    items.write.format("xml").option("rootTag", "rss").option("rowTag", "item").save(at)
    words = text.STORY_WORDS
    found = tables.read_feed(spark, at, per_source=200, first=F.lit("1996-01-01").cast("timestamp"), last=F.lit("1998-12-31").cast("timestamp"), story=lambda t: text.is_transfer_story(t, words))
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.to_date(F.min("published_at")).alias("first_day"), F.to_date(F.max("published_at")).alias("last_day"))


@query(
    "landed_news",
    """WITH d AS (SELECT doc_id, doc_id % 400 AS u, 'desk' || (doc_id % 6) || '.example' AS dom, doc_id % 3 AS desk, length(left(coalesce(text, ''), 300)) AS n FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY doc_id) AS r FROM d)
    SELECT CASE WHEN desk = 0 THEN dom ELSE dom || ' / Kim ' || desk END AS source, count(*) AS n, sum(n) AS chars FROM k WHERE r = 1 GROUP BY 1""",
)
def landed_news(spark, sf_dir):
    """Documents as pages of a news service, unpacked: byline beside the domain, the first row of an address, short snippets."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    item = F.struct(
        F.concat(F.lit("https://n.example/"), i % 400).alias("url"),
        F.format_string("%012d", i).alias("title"),
        F.lit("20240101T000000Z").alias("seendate"),
        F.concat(F.lit("desk"), i % 6, F.lit(".example")).alias("domain"),
        F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("Kim "), i % 3)).alias("byline"),
        F.coalesce("text", F.lit("")).alias("body"),
    )
    at = _folder(spark)
    d.select(F.array(item).alias("articles")).write.json(at)
    rows = tables.read_news_json(spark, at, lines=True)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("snippet")).alias("chars"))


@query(
    "landed_results",
    """WITH m AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS date, o_orderkey % 25 AS h, (o_orderkey // 25 + o_orderkey) % 25 AS a, o_orderkey % 5 AS hg, o_orderkey % 3 AS ag FROM orders WHERE o_orderkey % 25 <> (o_orderkey // 25 + o_orderkey) % 25),
    e AS (SELECT k, date, h AS c, a AS o, 'home' AS venue, hg AS gf, ag AS ga FROM m UNION ALL SELECT k, date, a, h, 'away', ag, hg FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY date, c, o ORDER BY venue DESC, gf, ga) AS r FROM e WHERE c % 2 = 0)
    SELECT 'NATION_' || c AS club, count(*) AS n, count_if(gf > ga) AS wins, count_if(gf = ga) AS draws, count_if(venue = 'home') AS home, sum(gf) AS goals FROM r WHERE r = 1 GROUP BY 1""",
)
def landed_results(spark, sf_dir):
    """Orders as league rows with three spellings of dates, to results of the known clubs, one per day, club and opponent."""
    k, at = F.col("o_orderkey"), _folder(spark)
    o = table(spark, sf_dir, "orders").withColumn("away", (F.floor(k / 25) + k) % 25).where(k % 25 != F.col("away"))
    day = F.when(k % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when((k % 3 == 1) & (F.year("o_orderdate") >= 2000), F.date_format("o_orderdate", "dd/MM/yy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    name = lambda c: F.concat(F.lit("Nation "), c)
    o.select(day.alias("Date"), name(k % 25).alias("HomeTeam"), name(F.col("away")).alias("AwayTeam"), (k % 5).alias("FTHG"), (k % 3).alias("FTAG")).write.csv(at, header=True)
    rows = tables.read_rows(spark, at, "Date STRING, HomeTeam STRING, AwayTeam STRING, FTHG STRING, FTAG STRING")
    n = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("nation "), "n_nationkey").alias("alias_norm"), F.concat(F.lit("NATION_"), "n_nationkey").alias("club"))
    found = tables.league_results(rows, n)
    turn = F.row_number().over(Window.partitionBy("date", "club", "opponent").orderBy(F.desc("venue"), "goals_for", "goals_against"))
    one = found.withColumn("turn", turn).where("turn = 1")
    return one.groupBy("club").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("result") == "W").alias("wins"), F.count_if(F.col("result") == "D").alias("draws"), F.count_if(F.col("venue") == "home").alias("home"), F.sum("goals_for").alias("goals"))


@query(
    "article_records",
    f"""WITH {HEADLINES}, h AS (SELECT *, 'https://a.example/' || article_id || '?utm_source=x&id=' || (article_id % 3) AS url FROM headlines),
    n AS (SELECT article_id AS k, title, 'https://a.example/' || article_id || '?id=' || (article_id % 3) AS normal, club, date FROM h)
    SELECT k, left(sha1(normal || '||' || lower(title) || '||' || strftime(date, '%Y-%m-%dT00:00:00Z') || '||' || 'the desk / kim ' || (k % 9)), 16) AS article_id, 'Kim ' || (k % 9) AS journalist, 'The Desk' AS provider,
      CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS n_players, club AS named, CASE WHEN k % 5 = 0 THEN 0.5e0 ELSE 0.9e0 END AS confidence FROM n""",
)
def article_records(spark, sf_dir):
    """Headlines as article records: ids, reporters, clubs named in them."""
    h = b.headlines(spark, sf_dir)
    nations = table(spark, sf_dir, "nation").select(F.replace("n_name", F.lit("_"), F.lit(" ")).alias("name")).orderBy("n_nationkey").collect()  # a dimension
    clubs = F.array(*(F.struct(F.lit(r.name).alias("name"), F.array().cast("array<string>").alias("aliases")) for r in nations))
    # One row, so that labels are made once and not for every article.
    h = h.join(F.broadcast(spark.range(1).select(text.club_labels(clubs).alias("clubs"))))
    i = F.col("article_id")
    rows = h.select(
        "clubs",
        F.concat(F.lit("  "), "title", F.lit(" ")).alias("title"),
        F.concat(F.lit("https://a.example/"), i, F.lit("?utm_source=x&id="), i % 3).alias("url"),
        F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        F.concat(F.lit("The Desk / Kim "), i % 9).alias("source"),
        F.when(i % 4 == 0, F.col("player")).alias("player"),
        F.when(i % 5 != 0, F.lit("0.9")).alias("extraction_confidence"),
        F.lit("").alias("snippet"),
    )
    a = im.normalised_articles(rows, F.col("clubs"), labelled=True)
    key = F.regexp_extract("url", r"/(\d+)\?", 1).cast("bigint")
    return a.select(key.alias("k"), "article_id", "journalist", "provider", F.size("player_candidates").alias("n_players"), F.array_join("club_candidates", "|").alias("named"), F.col("extraction_confidence").alias("confidence"))


@query(
    "new_articles",
    """WITH o AS (SELECT o_orderkey % 3000 AS u, CAST(o_orderdate AS DATE) AS day, o_orderkey AS k FROM orders), s AS (SELECT DISTINCT u, day FROM o WHERE day < DATE '1998-01-01'), f AS (SELECT o.* FROM o LEFT JOIN s ON o.u = s.u AND o.day = s.day WHERE s.u IS NULL)
    SELECT 'https://a.example/' || u AS normalized_url, day, min(k) AS k FROM f GROUP BY 1, 2""",
)
def new_articles(spark, sf_dir):
    """Articles of a poll that are not stored yet; those before 1998 are."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("https://a.example/"), F.col("o_orderkey") % 3000).alias("normalized_url"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("k"))
    return im.new_only(o, o.where("day < date'1998-01-01'"), ["normalized_url", "day"])


@query(
    "chosen_clubs",
    f"""WITH {HEADLINES}, h AS (SELECT article_id AS k, replace(club, '_', ' ') AS own, 'NATION ' || ((article_id * 7) % 25) AS other, title FROM headlines)
    SELECT k, CASE WHEN k % 6 = 0 THEN 'Given' WHEN k % 6 = 1 THEN other WHEN contains(lower(title), lower(other)) AND other < own THEN other ELSE own END AS club FROM h""",
)
def chosen_clubs(spark, sf_dir):
    """The club of each headline: the given one, the only candidate, or the one that it names."""
    i = F.col("article_id")
    other = F.concat(F.lit("NATION "), (i * 7) % 25)
    h = b.headlines(spark, sf_dir)
    candidates = F.when(i % 6 == 1, F.array(other)).otherwise(F.array(other, F.col("club")))
    return h.select(i.alias("k"), im.chosen_club(candidates, F.col("title"), F.lit(""), F.when(i % 6 == 0, " Given ")).alias("club"))


@query(
    "claim_notes",
    """WITH c AS (SELECT o_orderkey AS k, (['IN', 'sideways', '', 'out'])[o_orderkey % 4 + 1] AS d, (['talks', 'Done', 'official'])[o_orderkey % 3 + 1] AS s, (['loan', 'swap', 'permanent', 'option', NULL])[o_orderkey % 5 + 1] AS t, o_orderkey % 7 <> 0 AS related, o_orderkey % 11 <> 0 AS p, o_orderkey % 13 <> 0 AS cl, o_orderkey % 8 = 0 AS live FROM orders)
    SELECT k, CASE WHEN NOT related THEN 'unclear' WHEN d = 'IN' THEN 'in' WHEN d = 'out' THEN 'out' ELSE 'unclear' END AS direction, CASE WHEN NOT related OR s = 'Done' THEN 'unclear' ELSE s END AS stage, CASE WHEN t = 'swap' THEN 'unclear' ELSE coalesce(t, 'unclear') END AS transfer_type,
      round(0.8e0 * CASE WHEN p AND cl THEN 1 ELSE 0.7e0 END * CASE WHEN related THEN 1 ELSE 0.4e0 END * CASE WHEN live THEN 0.6e0 ELSE 1 END + 1e-9, 4) AS confidence,
      concat_ws('|', CASE WHEN d = 'sideways' THEN 'invalid_direction' END, CASE WHEN s = 'Done' THEN 'invalid_stage' END, CASE WHEN t = 'swap' THEN 'invalid_transfer_type' END, CASE WHEN NOT related THEN 'not_transfer_related' END, CASE WHEN NOT p THEN 'missing_player' END, CASE WHEN NOT cl THEN 'missing_club' END) AS notes FROM c""",
)
def claim_notes(spark, sf_dir):
    """Claims with values outside the known ones, missing names and live blogs, checked and noted."""
    k = F.col("o_orderkey")
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    c = table(spark, sf_dir, "orders").select(
        k.alias("k"),
        of(("IN", "sideways", "", "out"), 4).alias("direction"),
        of(("talks", "Done", "official"), 3).alias("stage"),
        of(("loan", "swap", "permanent", "option", None), 5).alias("transfer_type"),
        (k % 7 != 0).alias("related"),
        F.when(k % 11 != 0, "Pat").alias("player"),
        F.when(k % 13 != 0, "Ajax").otherwise(" ").alias("club"),
        F.when(k % 8 == 0, "Live: window").otherwise("News").alias("title"),
        F.lit(0.8).alias("confidence"),
    )
    return im.validated_claims(c).select("k", "direction", "stage", "transfer_type", rounded(F.col("confidence")).alias("confidence"), F.array_join("notes", "|").alias("notes"))


@query(
    "window_transfers",
    """WITH r AS (SELECT l_orderkey AS k, l_linenumber AS line, year(l_shipdate) AS y, l_extendedprice AS fee, l_returnflag AS f, l_suppkey % 30 AS c, l_partkey % 40 AS o FROM lineitem)
    SELECT club, direction, transfer_type, season, count(*) AS n, min(date) AS first_day, round(sum(fee_eur), 0) AS fees, min(from_club) AS from_club FROM (
      SELECT 'Nation ' || c AS club, CASE WHEN k % 2 = 0 THEN 'in' ELSE 'out' END AS direction, CASE WHEN f = 'A' THEN 'loan' ELSE 'permanent' END AS transfer_type, y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season,
        CASE WHEN line % 2 = 0 THEN make_date(y + 1, 1, 1) ELSE make_date(y, 7, 1) END AS date, CASE WHEN line % 3 <> 0 THEN floor(fee) / 1000.0e0 * 1000000 END AS fee_eur, CASE WHEN k % 2 = 0 THEN 'Club ' || o ELSE 'Nation ' || c END AS from_club
      FROM r WHERE c < 25 AND y BETWEEN 1995 AND 1998) GROUP BY 1, 2, 3, 4""",
)
def window_transfers(spark, sf_dir):
    """Line items as rows of a source that knows windows only."""
    l, k = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    y = F.year("l_shipdate")
    say = lambda a, c: F.concat(F.lit(a), c)
    rows = l.select(
        say(" Nation ", F.col("l_suppkey") % 30).alias("club_name"),
        F.when(k % 3 == 0, F.concat(y, F.lit("/"), y + 1)).when(k % 3 == 1, "unknown").otherwise(F.concat(F.lit(" "), y, F.lit("/"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))).alias("season"),
        y.cast("string").alias("year"),
        say("Pat ", k).alias("player_name"),
        F.lit("21").alias("age"),
        F.lit("x").alias("position"),
        say("Club ", F.col("l_partkey") % 40).alias("club_involved_name"),
        F.when(F.col("l_returnflag") == "A", "End of Loan").otherwise("1m").alias("fee"),
        F.when(F.col("l_linenumber") % 3 != 0, (F.floor("l_extendedprice") / 1000).cast("string")).otherwise("NA").alias("fee_cleaned"),
        F.when(k % 2 == 0, " In").otherwise("out").alias("transfer_movement"),
        F.when(F.col("l_linenumber") % 2 == 0, "Winter").otherwise("Summer").alias("transfer_period"),
    )
    names = table(spark, sf_dir, "nation").select(say("NATION ", F.col("n_nationkey")).alias("alias"))
    t = im.window_transfers(rows, names, "1995-96", "1998-99")
    # The smallest text of a group needs sorted rows; with it as a key first, rows are counted in hash tables.
    few = t.groupBy("club", "direction", "transfer_type", "season", "from_club").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.sum("transfer_fee_eur").alias("fees"))
    return few.groupBy("club", "direction", "transfer_type", "season").agg(F.sum("n").alias("n"), F.min("first_day").alias("first_day"), F.round(F.sum("fees"), 0).alias("fees"), F.min("from_club").alias("from_club"))


@query(
    "dated_transfers",
    """WITH m AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS move_id, o_custkey AS p, CAST(l_shipdate AS DATE) AS d, c_nationkey AS f, s_nationkey AS t, l_extendedprice AS fee, CASE WHEN l_returnflag = 'A' THEN 'loan' ELSE 'permanent' END AS kind
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
    e AS (SELECT move_id, p, d, t AS c, 'in' AS direction, fee, kind FROM m UNION ALL SELECT move_id, p, d, f, 'out', fee, kind FROM m),
    w AS (SELECT *, row_number() OVER (PARTITION BY d, c, p, direction ORDER BY move_id) AS r FROM e WHERE c % 3 <> 0 AND d <= DATE '1998-12-31' AND d >= DATE '1995-07-01')
    SELECT 'Nation ' || c AS club, direction, kind AS transfer_type, count(*) AS n, CAST(sum(CAST(round(fee) AS BIGINT)) AS BIGINT) AS fees, min(year(d) - year(b) - CAST(strftime(d, '%m%d') < strftime(b, '%m%d') AS INTEGER)) AS youngest FROM (SELECT *, DATE '1970-01-01' + CAST(p % 3000 AS INTEGER) AS b FROM w WHERE r = 1) GROUP BY 1, 2, 3""",
)
def dated_transfers(spark, sf_dir):
    """Line items as moves with exact dates; clubs are known by name or code, or by part of one."""
    l, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    club = lambda k: F.concat(F.lit("The Nation <"), F.col(k), F.lit(">"))
    moves = rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("move_id"),
        F.col("o_custkey").alias("player_id"),
        F.concat(F.lit("P"), F.col("o_custkey")).alias("player_name"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("transfer_date"),
        F.lit("").alias("transfer_season"),
        F.col("c_nationkey").alias("from_club_id"),
        club("c_nationkey").alias("from_club_name"),
        F.col("s_nationkey").alias("to_club_id"),
        club("s_nationkey").alias("to_club_name"),
        F.col("l_extendedprice").alias("fee"),
        F.lit(None).cast("double").alias("market_value"),
        F.when(F.col("l_returnflag") == "A", "loan").otherwise("permanent").alias("kind"),
    )
    players = c.select(F.col("c_custkey").alias("player_id"), F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int")), "yyyy-MM-dd").alias("date_of_birth"), F.lit("x").alias("position"))
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    clubs = n.select(k.alias("club_id"), F.when(k % 2 == 0, F.concat(F.lit("Real Nation <"), k, F.lit("> United"))).otherwise("").alias("name"), F.concat(F.lit("n-<"), k, F.lit(">")).alias("club_code"))
    names = n.where(k % 3 != 0).select(F.concat(F.lit("The N <"), k, F.lit(">")).alias("alias"), F.concat(F.lit("Nation "), k).alias("canonical")).unionByName(n.where(k % 3 != 0).select(F.concat(F.lit("Nation <"), k, F.lit(">")).alias("alias"), F.concat(F.lit("Nation "), k).alias("canonical")))
    t = im.dated_transfers(moves, players, im.club_ids(clubs, names), "1995-96", "1998-99", F.lit("1998-12-31").cast("date"))
    return t.groupBy("club", "direction", "transfer_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("transfer_fee_eur").cast("bigint")).alias("fees"), F.min("age").alias("youngest"))


@query(
    "clean_transfers",
    f"""WITH {TRANSFERS} SELECT is_loan, transfer_type, count(*) AS n, round(sum(transfer_fee_eur), 1) AS fees, count(DISTINCT season) AS seasons FROM (
      SELECT *, CASE WHEN is_loan THEN 'loan' ELSE 'permanent' END AS transfer_type, year(date) - CAST(month(date) < 7 AS INTEGER) AS season FROM transfers WHERE deal_id % 10 <> 0) WHERE NOT is_loan GROUP BY 1, 2""",
)
def clean_transfers(spark, sf_dir):
    """Moves written as a transfer file, some with unknown directions, read with checks, without loans, and written clean."""
    t, at = b.transfers(spark, sf_dir), _folder(spark)
    way = F.when(F.col("deal_id") % 10 == 0, "sideways").otherwise(F.col("direction"))
    raw = t.select("date", F.concat(F.lit("Nation "), "to_id").alias("club"), "player", way.alias("direction"), F.lit("a").alias("from_club"), F.lit("b").alias("to_club"), "age", "position", "market_value_eur", "transfer_fee_eur", "wage_eur_annual", F.lit("s").alias("source"), F.lit("u").alias("source_url"), F.lit(None).cast("string").alias("season"), F.lit(None).cast("string").alias("transfer_type"), "is_loan")
    raw.write.csv(f"{at}/raw", header=True)
    good, _ = tables.read_transfers(spark, f"{at}/raw")
    sinks.write_rows(im.by_loan_policy(good, "exclude"), f"{at}/clean", im.CLEAN_FIELDS)
    clean = tables.read_rows(spark, f"{at}/clean", "date DATE, season STRING, club STRING, player STRING, direction STRING, from_club STRING, to_club STRING, age DOUBLE, position STRING, market_value_eur DOUBLE, transfer_fee_eur DOUBLE, wage_eur_annual DOUBLE, transfer_type STRING, is_loan BOOLEAN, source STRING, source_url STRING")
    return clean.groupBy("is_loan", "transfer_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("transfer_fee_eur"), 1).alias("fees"), F.countDistinct("season").alias("seasons"))


@query(
    "dearest_moves",
    f"""WITH {TRANSFERS} SELECT deal_id, line, player_id, round(transfer_fee_eur, 2) AS fee FROM transfers WHERE NOT is_loan AND transfer_fee_eur >= 50000 ORDER BY transfer_fee_eur DESC, deal_id, line, player_id LIMIT 40 OFFSET 10""",
)
def dearest_moves(spark, sf_dir):
    """Places 11 to 50 of the dearest moves that are no loans."""
    t = im.transfer_view(b.transfers(spark, sf_dir), ["deal_id", "line", "player_id"], "exclude", 50_000, "fee", 10, 40)
    return t.select("deal_id", "line", "player_id", F.round("transfer_fee_eur", 2).alias("fee"))
