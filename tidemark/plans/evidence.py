"""Queries over evidence: benchmark passages are searched for in the documents; conversations are audited."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import dates, scoring, text
from tidemark.operators import grounding, retrieval as rt
from tidemark.operators.evidence_index import EvidenceIndex
from tidemark.sources import bindings as b
from tidemark.sources.tables import table
from tidemark.storage import shared_dir

from .registry import query
from .sql_bindings import ARTICLES

AS_OF = "2024-02-01"


#: Kinds that stand for those of the documents, by doc_id mod their number.
KINDS = ("article", "transfer", "signal")


def corpus(spark, sf_dir):
    """Articles as evidence: the reporter is the desk of a language."""
    a = b.articles(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("article_id") % len(KINDS) + 1).cast("int"))
    return a.select(F.col("article_id").alias("doc"), "title", F.col("body").alias("text"), "source", F.concat(F.lit("desk "), "lang").alias("reporter"), kind.alias("doc_type"), "published_at")


def asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("query"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TOK = lambda x: f"list_filter(list_transform(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9_''-]*'), lambda t: trim(t, '''')), lambda t: length(t) >= 2 AND NOT list_contains([{_STOP}], t))"
_BONUS = """
CASE WHEN contains(array_to_string(d.t, ' '), array_to_string(qt.w, ' ')) THEN 4
     WHEN contains(array_to_string(d.w, ' '), array_to_string(qt.w, ' ')) THEN 2 ELSE 0 END"""
_LEX = f"""{ARTICLES},
a2 AS (SELECT *, 'desk ' || lang AS reporter, ({list(KINDS)})[article_id % {len(KINDS)} + 1] AS doc_type FROM articles),
dt AS (SELECT article_id AS doc, {_TOK("concat_ws(' ', title, title, body, reporter, source)")} AS w, {_TOK("coalesce(title, '')")} AS t FROM a2),
d AS (SELECT * FROM dt WHERE len(w) > 0),
qt AS (SELECT item_id AS q, {_TOK("coalesce(text, '')")} AS w FROM benchmark),
tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(w) AS term FROM d) GROUP BY 1, 2),
qf AS (SELECT q, term, count(*) AS qf FROM (SELECT q, unnest(w) AS term FROM qt) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(*) AS n FROM d),
s AS (
  SELECT q, doc, sum((1 + ln(tf)) * qf * (ln((n + 1) / (df + 0.5)) + 1)) AS s, count(*) AS matched
  FROM tf JOIN qf USING (term) JOIN df USING (term), n GROUP BY 1, 2),
bn AS (SELECT * FROM (SELECT q, doc, {_BONUS} AS bonus FROM d, qt WHERE len(qt.w) > 0) WHERE bonus > 0),
sb AS (SELECT q, doc, coalesce(s, 0) AS s, coalesce(bonus, 0) AS bonus, coalesce(matched, 0) AS matched FROM s FULL JOIN bn USING (q, doc)),
lex AS (
  SELECT sb.q, sb.doc, (s + bonus) * (1 + least(0.25, matched / len(list_distinct(qt.w)) * 0.25)) * greatest(0.35, 9 / sqrt(len(d.w))) AS lexical, matched
  FROM sb JOIN d ON d.doc = sb.doc JOIN qt ON qt.q = sb.q)"""
_TOP = lambda score, t, k: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY {score} DESC, doc) AS rank FROM {t}) WHERE rank <= {k}"
_rank = lambda: F.col("rank").cast("bigint").alias("rank")


@query("tfidf_topk", f"WITH {_LEX} SELECT q, doc, rank, matched, round(lexical, 4) AS score FROM ({_TOP('round(lexical, 6)', 'lex', 5)})")
def tfidf_topk(spark, sf_dir):
    hits = rt.search(corpus(spark, sf_dir), asked(spark, sf_dir), 5, ("lexical",))
    return hits.select("q", "doc", _rank(), "matched", F.round("score", 4).alias("score"))


def stored_index(spark, sf_dir):
    """The index of all articles, made of the earlier ones and extended twice; the extensions overlap what is stored."""
    index = EvidenceIndex(spark, f"{shared_dir(spark)}/evidence/{uuid.uuid4().hex}")
    docs = corpus(spark, sf_dir)
    day = F.to_date("published_at")
    index.extend(docs.where(day < F.lit("2024-01-01").cast("date") + F.expr("interval 2 days")))
    index.extend(docs.where(day <= F.lit("2024-01-05").cast("date")))
    index.extend(docs)
    return index


@query("indexed_topk", f"WITH {_LEX} SELECT q, doc, rank, matched, round(lexical, 4) AS score FROM ({_TOP('round(lexical, 6)', 'lex', 5)})")
def indexed_topk(spark, sf_dir):
    """The hits of tfidf_topk from a stored index: postings, block maxima, no document without a query word."""
    return stored_index(spark, sf_dir).topk(asked(spark, sf_dir), 5).select("q", "doc", _rank(), "matched", F.round("score", 4).alias("score"))


@query("index_stats", f"WITH {_LEX} SELECT doc_type AS kind, source, count(*) AS n FROM a2 GROUP BY 1, 2")
def index_stats(spark, sf_dir):
    """Documents of a stored index by kind and source."""
    return stored_index(spark, sf_dir).stats()


_PADDED = lambda x: f"'  ' || trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')) || '  '"
_GRAM = lambda x: f"list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3))"
_CHAR = f"""
pq AS (SELECT item_id AS q, {_PADDED('text')} AS x FROM benchmark WHERE trim(coalesce(text, '')) <> ''),
pd AS (SELECT article_id AS doc, {_PADDED("concat_ws(' ', title, reporter, source, body)")} AS x FROM a2),
gq AS (SELECT q, g, count(*) AS n FROM (SELECT q, unnest({_GRAM('x')}) AS g FROM pq) GROUP BY 1, 2),
gd AS (SELECT doc, g, count(*) AS n FROM (SELECT doc, unnest({_GRAM('x')}) AS g FROM pd) GROUP BY 1, 2),
nq AS (SELECT q, sqrt(sum(n * n)) AS z FROM gq GROUP BY 1),
nd AS (SELECT doc, sqrt(sum(n * n)) AS z FROM gd GROUP BY 1),
chr AS (
  SELECT * FROM (
    SELECT q, doc, sum(gq.n * gd.n) / (any_value(nq.z) * any_value(nd.z)) AS cosine
    FROM gq JOIN gd USING (g) JOIN nq USING (q) JOIN nd USING (doc) GROUP BY q, doc)
  WHERE cosine >= 0.05)"""
_A2 = "a2 AS (SELECT *, 'desk ' || lang AS reporter FROM articles)"


@query("chargram_cosine", f"WITH {ARTICLES}, {_A2}, {_CHAR} SELECT q, doc, rank, round(cosine, 4) AS cosine FROM ({_TOP('round(4.25 * cosine, 8)', 'chr', 5)})")
def chargram_cosine(spark, sf_dir):
    hits = rt.search(corpus(spark, sf_dir), asked(spark, sf_dir), 5, ("semantic",), digits=8)
    return hits.select("q", "doc", _rank(), F.round(F.col("semantic") / 4.25, 4).alias("cosine"))


_AGE = f"date_diff('day', CAST(a.published_at AS DATE), DATE '{AS_OF}')"
_FIELD = f"""
fv AS (
  SELECT DISTINCT 'reporter' AS f, 1.15e0 AS wt, reporter AS v FROM a2 WHERE reporter IS NOT NULL
  UNION SELECT DISTINCT 'source', 0.95e0, source FROM a2 WHERE source IS NOT NULL),
fw AS (SELECT * FROM (SELECT *, {_TOK('v')} AS w FROM fv) WHERE len(w) > 0),
ss AS (
  SELECT unnest(w) AS s FROM fw UNION SELECT array_to_string(w, ' ') FROM fw UNION SELECT unnest(w) FROM qt
  UNION SELECT text FROM benchmark WHERE text IS NOT NULL),
sg AS (SELECT s, g, count(*) AS n FROM (SELECT s, unnest({_GRAM('x')}) AS g FROM (SELECT s, {_PADDED('s')} AS x FROM ss WHERE trim(s) <> '')) GROUP BY 1, 2),
sz AS (SELECT s, sqrt(sum(n * n)) AS z FROM sg GROUP BY 1),
fs AS (SELECT DISTINCT unnest(w) AS s FROM fw UNION SELECT array_to_string(w, ' ') FROM fw),
cs AS (
  SELECT a.s AS a, b.s AS b, sum(a.n * b.n) / (any_value(x.z) * any_value(y.z)) AS c
  FROM sg a JOIN fs ON fs.s = a.s JOIN sg b USING (g) JOIN sz x ON x.s = a.s JOIN sz y ON y.s = b.s GROUP BY 1, 2),
fz AS (
  SELECT q, f, v, max(c) AS fuzzy FROM (
    SELECT q, f, v, c FROM (SELECT f, v, unnest(w) AS a FROM fw) JOIN cs USING (a) JOIN (SELECT q, unnest(w) AS b FROM qt) USING (b)
    UNION ALL SELECT item_id, f, v, c FROM (SELECT f, v, array_to_string(w, ' ') AS a FROM fw) JOIN cs USING (a) JOIN benchmark ON text = b)
  GROUP BY 1, 2, 3),
fp AS (
  SELECT qt.q, fw.f, fw.v, wt * CASE WHEN contains(array_to_string(qt.w, ' '), array_to_string(fw.w, ' ')) THEN 1.25e0
    WHEN list_has_any(qt.w, fw.w) THEN least(1, len(list_intersect(list_distinct(qt.w), list_distinct(fw.w))) / len(list_distinct(fw.w)))
    WHEN fuzzy >= 0.58 THEN fuzzy * 0.8e0 ELSE 0 END AS p
  FROM qt JOIN fw ON len(qt.w) > 0 LEFT JOIN fz ON fz.q = qt.q AND fz.f = fw.f AND fz.v = fw.v)"""
_HYBRID = f"""{_LEX}, {_CHAR}, {_FIELD},
h0 AS (
  SELECT qt.q, a.article_id AS doc, coalesce(lexical, 0) AS lexical, coalesce(matched, 0) AS matched, coalesce(4.25 * cosine, 0) AS semantic,
    3.25e0 * (coalesce(r.p, 0) + coalesce(c.p, 0) + CASE WHEN contains(array_to_string(qt.w, ' '), doc_type) THEN 0.5e0 ELSE 0 END) AS structured,
    coalesce(r.p, 0) + coalesce(c.p, 0) > 0 AS named,
    CASE WHEN {_AGE} < 0 THEN 0.03e0 WHEN {_AGE} <= 14 THEN 0.35e0 WHEN {_AGE} <= 60 THEN 0.22e0 WHEN {_AGE} <= 365 THEN 0.10e0 ELSE 0.0e0 END AS recency,
    CASE WHEN doc_type IN ('signal', 'article') THEN 1.07e0 ELSE 1 END AS boost
  FROM qt JOIN a2 a ON len(qt.w) > 0 JOIN d ON d.doc = a.article_id LEFT JOIN lex ON lex.q = qt.q AND lex.doc = a.article_id LEFT JOIN chr ON chr.q = qt.q AND chr.doc = a.article_id
    LEFT JOIN fp r ON r.q = qt.q AND r.f = 'reporter' AND r.v = a.reporter LEFT JOIN fp c ON c.q = qt.q AND c.f = 'source' AND c.v = a.source),
hs AS (
  SELECT * FROM (SELECT *, (lexical + semantic + structured + recency) * boost AS score,
    concat_ws('|', CASE WHEN lexical > 0 THEN 'lexical' END, CASE WHEN semantic > 0 THEN 'semantic_chargram' END,
      CASE WHEN structured > 0 THEN 'structured_entity' END, CASE WHEN recency > 0 THEN 'recency' END) AS methods FROM h0)
  WHERE score >= 0.35 OR matched > 0 OR named)"""


def hits_of(spark, sf_dir):
    return rt.search(corpus(spark, sf_dir), asked(spark, sf_dir), 5, as_of=F.lit(AS_OF).cast("date"))


@query("hybrid_topk", f"WITH {_HYBRID} SELECT q, doc, rank, round(score, 4) AS score, methods FROM ({_TOP('round(score, 6)', 'hs', 5)})")
def hybrid_topk(spark, sf_dir):
    return hits_of(spark, sf_dir).select("q", "doc", _rank(), F.round("score", 4).alias("score"), "methods")


@query(
    "multi_query_merge",
    f"""WITH {_HYBRID}, t AS ({_TOP('round(score, 6)', 'hs', 5)}),
    g AS (
      SELECT q // 4 AS question, doc, max(score) AS score, count(DISTINCT q) AS n_queries,
        array_to_string(list_sort(list_distinct(flatten(list(string_split(methods, '|'))))), '|') AS methods FROM t GROUP BY 1, 2)
    SELECT question, doc, round(score, 4) AS score, n_queries, methods FROM g""",
)
def multi_query_merge(spark, sf_dir):
    """Four queries form a question; their hits become one list."""
    return rt.merged(hits_of(spark, sf_dir).withColumn("question", F.floor(F.col("q") / 4))).withColumn("score", F.round("score", 4))


@query(
    "grounding_audit",
    f"""WITH c AS (SELECT conv_id, role, list_distinct({_TOK("coalesce(text, '')")}) AS w FROM conversations),
    e AS (SELECT conv_id, list_distinct(flatten(list(w) FILTER (WHERE role <> 'assistant'))) AS ev, list_filter(list_distinct(flatten(list(w) FILTER (WHERE role = 'assistant'))), lambda t: length(t) > 3) AS ans, count_if(role <> 'assistant') AS cites, count(DISTINCT role) AS roles FROM c GROUP BY 1),
    s AS (SELECT conv_id, cites, CASE WHEN coalesce(len(ans), 0) = 0 THEN 0.0e0 ELSE len(list_intersect(ans, coalesce(ev, []))) / len(ans) END AS support, least(1, roles / greatest(cites, 1) * 1.35e0) AS diversity, conv_id % 400 AS days FROM e),
    f AS (SELECT *, CASE WHEN days <= 14 THEN 1.0e0 WHEN days <= 45 THEN 0.76e0 WHEN days <= 120 THEN 0.55e0 WHEN days <= 365 THEN 0.34e0 ELSE 0.18e0 END AS fresh FROM s),
    o AS (SELECT *, round((0.26 * support + 0.14 * diversity + 0.12 * fresh) / 0.52 + 1e-9, 4) AS overall FROM f)
    SELECT conv_id, cites, round(support + 1e-9, 4) AS support, overall, CASE WHEN overall >= 0.82 THEN 'strong' WHEN overall >= 0.62 THEN 'usable' WHEN overall >= 0.42 THEN 'watch' ELSE 'needs_refresh' END AS status FROM o""",
)
def grounding_audit(spark, sf_dir):
    """How far each conversation's answers are covered by what was said before them. Words are counted per conversation as
    rows, so a very long conversation doesn't gather in one row."""
    c = table(spark, sf_dir, "conversations").withColumn("answer", F.coalesce(F.col("role") == "assistant", F.lit(False)))
    words = c.select("conv_id", "answer", F.explode(text.tokens(F.col("text"))).alias("w")).groupBy("conv_id", "w").agg(F.max(F.when(F.col("answer"), 1).otherwise(0)).alias("said"), F.max(F.when(F.col("answer"), 0).otherwise(1)).alias("shown"))
    told = words.where("said = 1 and char_length(w) > 3").groupBy("conv_id").agg(F.avg("shown").alias("support"))
    base = c.groupBy("conv_id").agg(F.count_if(~F.col("answer")).alias("cites"), F.countDistinct("role").alias("roles"))
    j = base.join(told.hint("merge"), "conv_id", "left").withColumn("support", F.coalesce("support", F.lit(0.0)))
    diversity = F.least(F.lit(1.0), F.col("roles") / F.greatest(F.col("cites"), F.lit(1)) * 1.35)
    fresh = dates.citation_freshness(F.col("conv_id") % 400)
    j = j.withColumn("overall", scoring.rounded((0.26 * F.col("support") + 0.14 * diversity + 0.12 * fresh) / 0.52))
    return j.select("conv_id", "cites", scoring.rounded(F.col("support")).alias("support"), "overall", scoring.score_status(F.col("overall")).alias("status"))


_SAID = "['lexical', 'semantic', 'structured']"


@query(
    "grounding_dimensions",
    f"""WITH c AS (SELECT conv_id AS run, turn, role, coalesce(text, '') AS text, coalesce(role = 'assistant', false) AS answer FROM conversations),
    w AS (SELECT DISTINCT run, answer, unnest(list_filter({_TOK("text")}, lambda t: length(t) > 3)) AS w FROM c),
    sp AS (SELECT a.run, avg(CASE WHEN b.w IS NULL THEN 0 ELSE 1 END) AS v FROM w a LEFT JOIN w b ON b.run = a.run AND b.w = a.w AND NOT b.answer WHERE a.answer GROUP BY a.run),
    ct AS (SELECT run, avg((turn % 10) / 10.0e0) AS strength, count(DISTINCT role || (turn % 3)) / count(*) * 1.35e0 AS diversity,
      avg(CASE WHEN turn % 4 <> 3 THEN greatest(date_diff('day', DATE '2024-01-01' + CAST((run * 7 + turn) % 500 AS INTEGER), DATE '2024-06-01'), 0) END) AS age FROM c WHERE NOT answer GROUP BY run),
    se AS (SELECT run, 0.35e0 * least(1, count(*) / 5.0e0) + 0.35e0 * least(1, count(DISTINCT ({_SAID})[turn % 3 + 1]) / 3.0e0) + 0.3e0 * least(1, sum(length(text) % 5) / 10.0e0) AS health FROM c GROUP BY run),
    an AS (SELECT run, CASE WHEN sum(CAST(length(text) % 3 = 0 AS INTEGER)) > 0 THEN 0.45e0 ELSE 0 END + CASE WHEN sum(CAST(length(text) % 2 = 0 AS INTEGER)) > 0 THEN 0.55e0 ELSE 0 END AS told FROM c WHERE answer GROUP BY run),
    d AS (SELECT an.run, round(coalesce(sp.v, 0) + 1e-9, 4) AS answer_support, round(coalesce(strength, 0) + 1e-9, 4) AS citation_strength, round(coalesce(least(1, diversity), 0) + 1e-9, 4) AS source_diversity, round(coalesce(health, 0) + 1e-9, 4) AS retrieval_health,
      round(CASE WHEN age IS NULL THEN 0.45e0 WHEN age <= 14 THEN 1.0e0 WHEN age <= 45 THEN 0.76e0 WHEN age <= 120 THEN 0.55e0 WHEN age <= 365 THEN 0.34e0 ELSE 0.18e0 END + 1e-9, 4) AS citation_freshness, round(told + 1e-9, 4) AS uncertainty_disclosure
      FROM an LEFT JOIN sp USING (run) LEFT JOIN ct USING (run) LEFT JOIN se USING (run)),
    o AS (SELECT *, round(0.26e0 * answer_support + 0.18e0 * citation_strength + 0.14e0 * source_diversity + 0.18e0 * retrieval_health + 0.12e0 * citation_freshness + 0.12e0 * uncertainty_disclosure + 1e-9, 4) AS overall FROM d)
    SELECT *, CASE WHEN overall >= 0.82 THEN 'strong' WHEN overall >= 0.62 THEN 'usable' WHEN overall >= 0.42 THEN 'watch' ELSE 'needs_refresh' END AS status,
      coalesce(nullif(concat_ws('|', CASE WHEN answer_support < 0.65 THEN 'improve_grounding' END, CASE WHEN source_diversity < 0.6 THEN 'more_sources' END, CASE WHEN retrieval_health < 0.65 THEN 'rebuild_index' END, CASE WHEN citation_freshness < 0.55 THEN 'refresh_articles' END), ''), 'usable') AS advice FROM o""",
)
def grounding_dimensions(spark, sf_dir):
    """Six dimensions of each conversation: the assistant answers, other turns are cited, every turn is a search."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("answer"))
    size, turn = F.char_length("text"), F.col("turn")
    answers = c.where("answer").select("run", "text", (size % 3 == 0).cast("int").alias("warnings"), (size % 2 == 0).cast("int").alias("notes"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("run") * 7 + turn) % 500).cast("int"))
    citations = c.where("not answer").select("run", "text", F.concat("role", turn % 3).alias("source"), F.when(turn % 4 != 3, day).alias("day"), ((turn % 10) / 10.0).alias("strength"))
    method = F.element_at(F.array(*map(F.lit, ("lexical", "semantic", "structured"))), (turn % 3 + 1).cast("int"))
    searches = c.select("run", turn.alias("purpose"), method.alias("method"), (size % 5).alias("hits"))
    found = grounding.audit(answers, citations, searches, F.lit("2024-06-01").cast("date"))
    return found.drop("warnings").withColumn("advice", F.array_join("advice", "|"))
