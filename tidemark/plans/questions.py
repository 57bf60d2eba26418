"""Queries over questions and evidence of several kinds: routing, the signal meant, citations, counters, landed address maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import citations as ct
from tidemark.operators import retrieval as rt
from tidemark.operators import routing
from tidemark.sources import bindings as b
from tidemark.sources.tables import table
from tidemark.streaming import jobs

from .evidence import _LEX, _TOP, asked, corpus
from .registry import query
from .sql_bindings import ARTICLES, CLAIMS, PREDICTIONS, TRANSFERS
from .streams import _finished

LATEST_SEASON = "2000-01"
CLUBS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

#: Questions made from orders, by o_orderkey mod their number: a club, another one, a player, a reporter.
FORMS = (
    "Compare {club} with {other}",
    "Latest on {club}?",
    "Which reporter covers {club}?",
    "Explain the rumor about {player}!",
    "Any similar cases to {player} at {club}?",
    "Stock price of {club} after the result",
    "Past transfers of {club} in 2023-24",
    "How good is {reporter}?",
    "News of Pat from {club}",
    "Confirmed transfer of {club} and {other}",
    "Is it raining?",
)


def questions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    form = F.element_at(F.array(*map(F.lit, FORMS)), (k % len(FORMS) + 1).cast("int"))
    other = F.element_at(F.array(*map(F.lit, CLUBS)), (k % len(CLUBS) + 1).cast("int"))
    parts = {"{club}": F.col("c_mktsegment"), "{other}": other, "{player}": F.concat(F.lit("Pat Surname"), F.col("c_custkey") % 60), "{reporter}": F.concat(F.lit("Kim Desk"), F.col("c_custkey") % 100)}
    for name, value in parts.items():
        form = F.replace(form, F.lit(name), value)
    return o.select(k.alias("q"), form.alias("question"))


def names(spark, sf_dir):
    """Clubs, reporters and players that a question can name."""
    c = table(spark, sf_dir, "customer")
    return tuple(c.select(x.alias("name")).distinct() for x in (F.col("c_mktsegment"), F.concat(F.lit("Kim Desk"), F.col("c_custkey") % 100), F.concat(F.lit("Pat Surname"), F.col("c_custkey") % 60)))


_FILLED = "(" + repr(list(FORMS)).replace('"', "'") + f")[o_orderkey % {len(FORMS)} + 1]"
for _name, _value in {"{club}": "c_mktsegment", "{other}": f"({list(CLUBS)})[o_orderkey % {len(CLUBS)} + 1]", "{player}": "'Pat Surname' || (c_custkey % 60)", "{reporter}": "'Kim Desk' || (c_custkey % 100)"}.items():
    _FILLED = f"replace({_FILLED}, '{_name}', {_value})"
_NORM = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_ROUTED = f"""qs AS (SELECT q, question, {_NORM("question")} AS n FROM (SELECT o_orderkey AS q, {_FILLED} AS question FROM orders JOIN customer ON o_custkey = c_custkey)),
nm AS (SELECT kind, name, {_NORM("name")} AS n, list_filter(string_split({_NORM("name")}, ' '), lambda w: length(w) > 2) AS long FROM (
  SELECT DISTINCT 'club' AS kind, c_mktsegment AS name FROM customer UNION SELECT 'reporter', 'Kim Desk' || (c_custkey % 100) FROM customer UNION SELECT 'player', 'Pat Surname' || (c_custkey % 60) FROM customer)),
sc AS (SELECT q, kind, name, strpos(' ' || qs.n || ' ', ' ' || nm.n || ' ') AS p, list_filter(nm.long, lambda w: strpos(' ' || qs.n || ' ', ' ' || w || ' ') > 0) AS hit, nm.n AS nn, nm.long, qs.n AS qn FROM (SELECT DISTINCT q, kind, name FROM (SELECT DISTINCT q, unnest(string_split(n, ' ')) AS w FROM qs) JOIN (SELECT kind, name, unnest(string_split(n, ' ')) AS w FROM nm) USING (w)) pair JOIN qs USING (q) JOIN nm USING (kind, name)),
gr AS (SELECT q, kind, name, CASE WHEN p > 0 THEN 100 + length(nn) WHEN len(long) > 0 AND len(hit) = len(long) THEN 70 + len(long) ELSE len(hit) END AS score, CASE WHEN p > 0 THEN p ELSE list_min(list_transform(long, lambda w: strpos(' ' || qn || ' ', ' ' || w || ' '))) END AS place FROM sc WHERE p > 0 OR len(hit) > 0),
best AS (SELECT q, kind, name FROM (SELECT *, row_number() OVER (PARTITION BY q, kind ORDER BY score DESC, name) AS r FROM gr) WHERE r = 1),
cl AS (SELECT q, list(name ORDER BY place, name) AS names FROM gr WHERE kind = 'club' AND score > 70 GROUP BY q),
ft AS (SELECT qs.q, qs.n, qs.question, CASE WHEN len(cl.names) >= 2 THEN cl.names[1] ELSE bc.name END AS club, cl.names[2] AS other, br.name AS reporter, bp.name AS player
  FROM qs LEFT JOIN cl USING (q) LEFT JOIN (SELECT q, name FROM best WHERE kind = 'club') bc USING (q) LEFT JOIN (SELECT q, name FROM best WHERE kind = 'reporter') br USING (q) LEFT JOIN (SELECT q, name FROM best WHERE kind = 'player') bp USING (q)),
rt AS (SELECT *, CASE WHEN other IS NOT NULL AND (contains(n, 'compare') OR contains(n, ' versus ') OR contains(n, ' vs ') OR contains(n, ' v ') OR contains(' ' || n || ' ', ' and ')) THEN 'compare_clubs' WHEN reporter IS NOT NULL THEN 'reporter_profile'
  WHEN club IS NOT NULL AND regexp_matches(n, 'reporter|journalist|source|credibility') THEN 'club_reporters' WHEN player IS NOT NULL AND contains(n, 'similar') THEN 'similar_historical_cases' WHEN player IS NOT NULL THEN 'explain_rumor'
  WHEN club IS NOT NULL AND regexp_matches(n, 'match|result|stock|price') THEN 'match_stock_context' WHEN club IS NOT NULL AND regexp_matches(n, 'confirmed|transfer|past|history') THEN 'confirmed_transfers' WHEN club IS NOT NULL THEN 'current_signals_for_club' ELSE 'unknown' END AS intent FROM ft)"""


@query(
    "question_routing",
    f"""WITH {_ROUTED} SELECT q, intent, CASE WHEN intent IN ('compare_clubs', 'club_reporters', 'match_stock_context', 'confirmed_transfers', 'current_signals_for_club') THEN club END AS club, CASE WHEN intent = 'compare_clubs' THEN other END AS other_club,
    CASE WHEN intent = 'reporter_profile' THEN reporter END AS reporter, CASE WHEN intent IN ('similar_historical_cases', 'explain_rumor') THEN player END AS player,
    CASE WHEN intent = 'confirmed_transfers' THEN coalesce(nullif(regexp_extract(question, '\\b(20\\d{{2}}-\\d{{2}})\\b', 1), ''), '{LATEST_SEASON}') END AS season FROM rt""",
)
def question_routing(spark, sf_dir):
    """What each question asks for, and of whom."""
    clubs, reporters, players = names(spark, sf_dir)
    return routing.route(questions(spark, sf_dir), clubs, reporters, players, LATEST_SEASON)


@query(
    "question_signals",
    f"""WITH {_ROUTED}, {PREDICTIONS}, s AS (SELECT case_id AS signal_id, 'Pat Surname' || (case_id % 60) AS player, club, round(abs(prob_positive - prob_negative), 6) AS strength FROM predictions),
    bp AS (SELECT player, arg_min(signal_id, (-strength, signal_id)) AS signal_id, arg_min(club, (-strength, signal_id)) AS club FROM s GROUP BY 1), bc AS (SELECT club, arg_min(signal_id, (-strength, signal_id)) AS signal_id FROM s GROUP BY 1),
    ba AS (SELECT arg_min(signal_id, (-strength, signal_id)) AS signal_id FROM s), j AS (SELECT ft.q, ft.club, bp.signal_id AS p, bc.signal_id AS c, ba.signal_id AS a, bp.signal_id IS NOT NULL AND (ft.club IS NULL OR ft.club = bp.club) AS fits FROM ft LEFT JOIN bp USING (player) LEFT JOIN bc ON bc.club = ft.club, ba)
    SELECT q, CASE WHEN fits THEN p WHEN club IS NOT NULL THEN c ELSE a END AS signal_id, CASE WHEN fits THEN 'player' WHEN club IS NOT NULL THEN 'club' ELSE 'all' END AS found_by FROM j""",
)
def question_signals(spark, sf_dir):
    """The signal each question is about."""
    p = b.predictions(spark, sf_dir)
    signals = p.select(F.col("case_id").alias("signal_id"), F.concat(F.lit("Pat Surname"), F.col("case_id") % 60).alias("player"), "club", F.round(F.abs(F.col("prob_positive") - F.col("prob_negative")), 6).alias("strength"))
    clubs, _, players = names(spark, sf_dir)
    q = questions(spark, sf_dir)
    named = q.select("q").join(routing.clubs(q, clubs).hint("merge"), "q", "left").join(routing.best_name(q, players).withColumnRenamed("name", "player").hint("merge"), "q", "left")
    return routing.signal_of(named, signals)


_ID = lambda kind, title, body, when="''": f"left(sha1('{kind}' || '||' || {title} || '||' || {body} || '||' || {when}), 16)"
_SQUEEZED = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query(
    "typed_documents",
    f"""WITH {PREDICTIONS}, {TRANSFERS}, {CLAIMS}, s AS (SELECT 'signal' AS doc_type, player || ' / ' || club AS title, 'Stage ' || rumor_stage || ', direction ' || direction || ', label ' || predicted_label AS text, club, player, NULL AS reporter, source FROM predictions),
    t AS (SELECT 'transfer', player || ' moves ' || direction, 'From ' || from_id || ' to ' || to_id || ' on ' || CAST(date AS VARCHAR), CAST(to_id AS VARCHAR), player, NULL, NULL FROM transfers),
    r AS (SELECT 'reporter', journalist, count(*) || ' claims about ' || count(DISTINCT club) || ' clubs', NULL, NULL, journalist, NULL FROM claims GROUP BY journalist),
    c AS (SELECT 'club', club, count(*) || ' claims by ' || count(DISTINCT journalist) || ' reporters', club, NULL, NULL, NULL FROM claims GROUP BY club),
    u AS (SELECT * FROM s UNION ALL SELECT * FROM t UNION ALL SELECT * FROM r UNION ALL SELECT * FROM c) SELECT *, left(sha1(doc_type || '||' || title || '||' || text || '||'), 16) AS doc_id FROM u""",
)
def typed_documents(spark, sf_dir):
    """Signals, moves, reporters and clubs as evidence documents."""
    c, say = F.col, lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    p, t, claims = b.predictions(spark, sf_dir), b.transfers(spark, sf_dir), b.claims(spark, sf_dir)
    signals = ct.documents("signal", p, say(c("player"), " / ", c("club")), say("Stage ", c("rumor_stage"), ", direction ", c("direction"), ", label ", c("predicted_label")), club=c("club"), player=c("player"), source=c("source"))
    moves = ct.documents("transfer", t, say(c("player"), " moves ", c("direction")), say("From ", c("from_id"), " to ", c("to_id"), " on ", c("date").cast("string")), club=c("to_id"), player=c("player"))
    by_reporter = claims.groupBy("journalist").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("club").alias("m"))
    by_club = claims.groupBy("club").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("journalist").alias("m"))
    reporters = ct.documents("reporter", by_reporter, c("journalist"), say(c("n"), " claims about ", c("m"), " clubs"), reporter=c("journalist"))
    clubs = ct.documents("club", by_club, c("club"), say(c("n"), " claims by ", c("m"), " reporters"), club=c("club"))
    return signals.unionByName(moves).unionByName(reporters).unionByName(clubs).drop("published_at")


_KINDS = ("article", "transfer", "stock_path", "signal", "signal", "club")
_NOTE = [n for _, n in ct.NOTES]


@query(
    "citation_notes",
    f"""WITH {_LEX}, h AS (SELECT q, ({list(_KINDS)})[doc % {len(_KINDS)} + 1] AS t FROM ({_TOP('round(lexical, 6)', 'lex', 3)})), g AS (SELECT q, count(*) AS n, list(DISTINCT t) AS ts FROM h GROUP BY 1)
    SELECT b.item_id AS q, coalesce(n, 0) AS n_citations, concat_ws('|', CASE WHEN NOT list_contains(coalesce(ts, []), 'article') THEN '{_NOTE[0]}' END, CASE WHEN NOT list_contains(coalesce(ts, []), 'transfer') THEN '{_NOTE[1]}' END,
      CASE WHEN NOT list_has_any(coalesce(ts, []), ['stock_path', 'match_result']) THEN '{_NOTE[2]}' END, '{_NOTE[3]}') AS notes FROM benchmark b LEFT JOIN g ON g.q = b.item_id""",
)
def citation_notes(spark, sf_dir):
    """How many citations each passage has, and what they lack."""
    q = asked(spark, sf_dir)
    hits = rt.search(corpus(spark, sf_dir), q, 3, ("lexical",))
    typed = hits.select("q", "doc", F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc") % len(_KINDS) + 1).cast("int")).alias("doc_type"))
    return ct.cited(q.select("q"), typed).withColumn("notes", F.array_join("notes", "|"))


_ENTITIES = f"{CLAIMS}, u AS (SELECT unnest(['club', 'player', 'reporter', 'source']) AS kind, unnest([club, player, journalist, source]) AS value, published_at FROM claims)"


@query("run_counters", f"WITH {_ENTITIES} SELECT kind, value, count(*) AS n, epoch_us(max(published_at)) AS last_us FROM u GROUP BY 1, 2")
def run_counters(spark, sf_dir):
    """Entities seen so far: the counters of the first two weeks with those of the rest added."""
    claims = b.claims(spark, sf_dir).withColumnsRenamed({"journalist": "reporter", "published_at": "seen_at"})
    rows = ct.entity_rows(claims, ["seen_at"])
    old = F.col("seen_at") < F.lit("2024-01-15").cast("timestamp_ntz")
    merged = ct.counters_merged(ct.counted(rows.where(old)), ct.counted(rows.where(~old | old.isNull())))
    return merged.select("kind", "value", "n", F.unix_micros(F.col("last_seen").cast("timestamp")).alias("last_us"))


@query("stream_run_counters", "SELECT unnest(['reporter', 'source']) AS kind, unnest([CAST(user_id AS VARCHAR), event_type]) AS value, event_id FROM events".join(("SELECT kind, value, count(*) AS n FROM (", ") GROUP BY 1, 2")))
def stream_run_counters(spark, sf_dir):
    """The same counters kept by a stream."""
    none = F.lit(None).cast("string")
    e = jobs.event_stream(spark, sf_dir).select(F.col("published_at").alias("seen_at"), none.alias("club"), none.alias("player"), F.col("user_id").alias("reporter"), F.col("event_type").alias("source"))
    return _finished(ct.counted(ct.entity_rows(e, ["seen_at"])), spark, True).select("kind", "value", "n")


@query(
    "unwrapped_urls",
    f"""WITH {ARTICLES}, a AS (SELECT article_id, CASE WHEN article_id % 2 = 0 THEN 'https://news.google.com/rss/articles/' || (article_id % 250) ELSE 'https://a.example/' || article_id END AS url, CASE WHEN article_id % 3 = 0 THEN 'Story ' || article_id || ' - The Paper' ELSE 'Story' END AS title, source, (article_id % 10) / 10.0e0 AS confidence FROM articles),
    m AS (SELECT 'https://news.google.com/rss/articles/' || page_id AS w, min(trim(regexp_replace(url, '\\s+', ' ', 'g'))) AS decoded FROM pages GROUP BY 1)
    SELECT article_id, coalesce(decoded, url) AS url, CASE WHEN decoded IS NOT NULL THEN url END AS original_url, CASE WHEN decoded IS NOT NULL AND title LIKE '% - %' THEN 'The Paper' ELSE source END AS source, CASE WHEN decoded IS NOT NULL THEN greatest(confidence, 0.68e0) ELSE confidence END AS confidence FROM a LEFT JOIN m ON a.url = m.w""",
)
def unwrapped_urls(spark, sf_dir):
    """Articles behind a feed's own addresses get the landed ones."""
    i = F.col("article_id")
    wrap = lambda n: F.concat(F.lit("https://news.google.com/rss/articles/"), n)
    a = b.articles(spark, sf_dir).select("article_id", F.when(i % 2 == 0, wrap(i % 250)).otherwise(F.concat(F.lit("https://a.example/"), i)).alias("url"), F.when(i % 3 == 0, F.concat(F.lit("Story "), i, F.lit(" - The Paper"))).otherwise("Story").alias("title"), "source", ((i % 10) / 10.0).alias("confidence"))
    landed = table(spark, sf_dir, "pages").select(wrap(F.col("page_id")).alias("url"), F.col("url").alias("decoded"))
    return ct.unwrapped(a, landed).drop("title")
