"""Queries over articles, pages and headlines: normal forms, dedupe, extraction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import claims as cl
from tidemark.functions import dates, text
from tidemark.sources import bindings as b
from tidemark.sources.tables import table

from .registry import query
from .sql_bindings import ARTICLES, CLAIMS, HEADLINES


@query(
    "normalize_urls",
    r"""WITH u AS (SELECT page_id, split_part(trim(url), '#', 1) AS u FROM pages),
    p AS (SELECT page_id, split_part(u, '?', 1) AS head, list_filter(string_split(CASE WHEN contains(u, '?') THEN substr(u, strpos(u, '?') + 1) ELSE '' END, '&'),
      lambda kv: regexp_matches(kv, '=.') AND NOT regexp_matches(lower(kv), '^(utm_|fbclid|gclid|cmpid|output|ref|refsrc)')) AS q FROM u),
    s AS (SELECT page_id, regexp_extract(head, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)', 1) AS origin, rtrim(regexp_replace(head, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '/') AS path, q FROM p)
    SELECT page_id, origin || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM s""",
)
def normalize_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"))


_STRIP = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({h}, '<(script|style|noscript)\\b.*?</(script|style|noscript)\\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"


def _block(t: str) -> str:
    inner = f"regexp_extract(html, '<{t}\\b[^>]*>(.*?)</{t}\\s*>', 1, 'is')"
    return f"CASE WHEN length({_STRIP.format(h=inner)}) >= 250 THEN {_STRIP.format(h=inner)} END"


@query("strip_html_text", f"SELECT page_id, {_STRIP.format(h='html')} AS stripped, coalesce({_block('article')}, {_block('main')}, {_block('body')}, {_STRIP.format(h='html')}) AS main FROM pages")
def strip_html_text(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(html).alias("stripped"), text.main_text(html).alias("main"))


@query(
    "article_dedupe",
    f"""WITH {ARTICLES}, k AS (SELECT *, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS norm FROM articles)
    SELECT norm, source, article_id, n FROM (SELECT norm, source, article_id, row_number() OVER w AS r, count(*) OVER (PARTITION BY norm, source) AS n FROM k WINDOW w AS (PARTITION BY norm, source ORDER BY published_at, article_id)) WHERE r = 1""",
)
def article_dedupe(spark, sf_dir):
    """First article of a title at a source. One aggregate with partial results, so very frequent titles don't gather in a task."""
    a = b.articles(spark, sf_dir).select(text.alnum_ascii(F.col("title")).alias("norm"), "source", "article_id", "published_at")
    first = F.min(F.struct("published_at", "article_id")).alias("first")
    return a.groupBy("norm", "source").agg(first, F.count(F.lit(1)).alias("n")).select("norm", "source", F.col("first.article_id").alias("article_id"), "n")


_FINGER = "array_to_string(list_filter(string_split(trim(regexp_replace(lower(h), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains([{common}], w))[1:10], ' ')".format(common=", ".join(f"'{w}'" for w in text.COMMON_HEADLINE_WORDS))


@query(
    "headline_fingerprints",
    f"""WITH {CLAIMS}, t AS (SELECT claim_id, source, player, published_at, regexp_replace(title, '^(.*) - .*$', '\\1') AS h FROM claims),
    f AS (SELECT *, {_FINGER} AS fingerprint FROM t), g AS (SELECT player, fingerprint, count(*) AS articles, count(DISTINCT source) AS sources, max(published_at) AS latest FROM f GROUP BY 1, 2)
    SELECT player, fingerprint, articles, sources, rank FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY articles DESC, sources DESC, latest DESC, fingerprint) AS rank FROM g) WHERE rank <= 4""",
)
def headline_fingerprints(spark, sf_dir):
    """The four most frequent headlines of each player."""
    c = b.claims(spark, sf_dir).withColumn("fingerprint", text.fingerprint(F.col("title")))
    g = c.groupBy("player", "fingerprint").agg(F.count(F.lit(1)).alias("articles"), F.countDistinct("source").alias("sources"), F.max("published_at").alias("latest"))
    rank = F.row_number().over(Window.partitionBy("player").orderBy(F.desc("articles"), F.desc("sources"), F.desc("latest"), "fingerprint"))
    return g.withColumn("rank", rank).where("rank <= 4").select("player", "fingerprint", "articles", "sources", F.col("rank").cast("bigint").alias("rank"))


@query("timestamp_formats", "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS seconds, event_id % 5 AS format FROM events")
def timestamp_formats(spark, sf_dir):
    """Event times written in five formats and read back."""
    e = table(spark, sf_dir, "events")
    f = F.col("event_id") % 5
    fmt = lambda p: F.date_format("ts", p)
    raw = (
        F.when(f == 0, fmt("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(f == 1, fmt("yyyy-MM-dd HH:mm:ss"))
        .when(f == 2, F.concat(F.lit("Mon, "), fmt("dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(f == 3, fmt("yyyyMMdd'T'HHmmss'Z'"))
        .otherwise(fmt("yyyyMMddHHmmss"))
    )
    return e.select("event_id", F.unix_timestamp(dates.parse_timestamp(raw)).alias("seconds"), f.alias("format"))


@query(
    "money_mentions",
    f"""WITH {HEADLINES}, m AS (SELECT article_id, CAST(regexp_extract(snippet, '[€$](\\d+(?:\\.\\d+)?)m', 1) AS DOUBLE) * CASE WHEN contains(snippet, '$') THEN 0.92 ELSE 1.0 END * 1e6 AS fee,
      CAST(nullif(regexp_extract(snippet, '£(\\d+)k a week', 1), '') AS DOUBLE) * 1000 * 1.17 * 52 AS wage FROM headlines)
    SELECT article_id, round(fee, 2) AS fee_eur, round(wage, 2) AS wage_eur FROM m""",
)
def money_mentions(spark, sf_dir):
    fee, wage = cl.fee_and_wage(F.col("snippet"))
    return b.headlines(spark, sf_dir).select("article_id", F.round(fee, 2).alias("fee_eur"), F.round(wage, 2).alias("wage_eur"))


def _pattern(p: str) -> str:
    return p.replace("'", "''")


_NORM = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"
_STAGE = f"CASE WHEN NOT regexp_matches(norm, '{_pattern(cl.context_pattern())}') THEN 'unclear' " + " ".join(f"WHEN regexp_matches(norm, '{'|'.join(p)}') THEN '{s}'" for s, p in cl.STAGES.items()) + " ELSE 'unclear' END"
_TYPE = f"CASE WHEN regexp_matches(norm, 'loan with option|loan option') THEN 'loan_with_option' WHEN regexp_matches(norm, 'option to buy|buy option') THEN 'option' WHEN contains(norm, 'loan') THEN 'loan' WHEN regexp_matches(norm, '{_pattern(cl.context_pattern())}') THEN 'permanent' ELSE 'unclear' END"


@query("stage_ladder", f"WITH {HEADLINES}, n AS (SELECT article_id, {_NORM} AS norm FROM headlines) SELECT article_id, {_STAGE} AS stage, {_TYPE} AS transfer_type FROM n")
def stage_ladder(spark, sf_dir):
    h = b.headlines(spark, sf_dir).withColumn("norm", text.alnum_folded(F.col("title"))).withColumn("context", cl.has_context(F.col("norm")))
    return h.select("article_id", cl.stage(F.col("norm"), F.col("context")).alias("stage"), cl.transfer_type(F.col("norm"), F.col("context")).alias("transfer_type"))


_C, _S = "lower(club)", "lower(split_part(player, ' ', -1))"
_LEAVES = f"regexp_matches(norm, '{'|'.join(cl.DEPARTURES)}') OR contains(norm, 'from ' || {_C}) OR contains(norm, {_C} || ' s ' || {_S}) OR contains(norm, {_S} || ' exit') OR contains(norm, 'close in on deal for')"
_ARRIVES = " OR ".join([f"contains(norm, {_C} || ' {p}')" for p in ("confirm agreement to sign", "sign", "move for", "bid for", "close on", "close in on")] + [f"contains(norm, '{p} ' || {_C})" for p in ("to", "join", "joins", "signs for")] + [f"contains(norm, '{p} ' || {_S})" for p in ("agreement to sign", "deal to sign", "sign", "signing", "deal for", "bid for", "move for")])


@query("direction", f"WITH {HEADLINES}, n AS (SELECT *, {_NORM} AS norm FROM headlines) SELECT article_id, CASE WHEN {_LEAVES} THEN 'out' WHEN {_ARRIVES} THEN 'in' ELSE 'unclear' END AS direction FROM n")
def direction(spark, sf_dir):
    h = b.headlines(spark, sf_dir).withColumn("norm", text.alnum_folded(F.col("title")))
    return h.select("article_id", cl.direction(F.col("norm"), F.col("club"), F.col("player")).alias("direction"))


@query(
    "lexicon_mentions",
    f"""WITH {HEADLINES}, lex AS (SELECT DISTINCT 'Pat Surname' || c_custkey AS name FROM customer UNION SELECT DISTINCT replace(n_name, '_', ' ') FROM nation),
    m AS (SELECT article_id AS id, name FROM headlines JOIN lex ON name IN (player, club))
    SELECT id, count(*) AS n_names, arg_min(name, (-length(name), name)) AS best FROM m GROUP BY id""",
)
def lexicon_mentions(spark, sf_dir):
    """Players and clubs named in headlines, and the longest name of each."""
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("Pat Surname"), F.col("c_custkey")).alias("name"))
    places = table(spark, sf_dir, "nation").select(F.replace("n_name", F.lit("_"), F.lit(" ")).alias("name"))
    found = cl.mentions(b.headlines(spark, sf_dir).select(F.col("article_id").alias("id"), F.col("title").alias("text")), people.unionByName(places).distinct())
    best = F.min_by("name", F.struct(-F.char_length("name"), "name"))
    # Numbers behind NATION are short, so only whole names meet there.
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n_names"), best.alias("best"))


@query(
    "claim_confidence",
    f"""WITH {HEADLINES}, n AS (SELECT *, {_NORM} AS norm FROM headlines), s AS (SELECT *, {_STAGE} AS stage, regexp_matches(norm, '{_pattern(cl.context_pattern())}') AS ctx FROM n),
    r AS (SELECT *, NOT regexp_matches(norm, '{'|'.join(cl.NOT_TRANSFERS)}') AND ctx AS related FROM s)
    SELECT article_id, related, stage, round((0.75e0 + CASE WHEN stage <> 'unclear' THEN 0.15e0 ELSE 0 END + CASE WHEN related THEN 0.10e0 ELSE 0 END) * CASE WHEN related THEN 1 ELSE 0.4e0 END, 4) AS confidence FROM r""",
)
def claim_confidence(spark, sf_dir):
    h = b.headlines(spark, sf_dir).withColumn("norm", text.alnum_folded(F.col("title")))
    h = h.withColumn("context", cl.has_context(F.col("norm")))
    h = h.withColumn("stage", cl.stage(F.col("norm"), F.col("context")))
    h = h.withColumn("related", cl.related(F.col("norm"), F.col("stage"), F.col("player"), F.col("club"), F.col("context")))
    score = cl.confidence(F.col("stage"), F.col("player"), F.col("club"), F.col("related"), F.size(cl.money(F.col("snippet"))) > 0)
    return h.select("article_id", "related", "stage", F.round(cl.validated(score, F.col("player"), F.col("club"), F.col("related"), F.col("title")), 4).alias("confidence"))
