"""Evidence of several kinds, what an answer still lacks, counters over runs, and landed maps of wrapped addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.storage import sided

ENTITIES = ("club", "player", "reporter", "source")
#: Hosts and paths of wrapped addresses.
WRAPPED = r"^https?://(www\.)?news\.google\.com/(.*/)?(rss/articles|articles|read)/"
#: What an answer lacks when none of the kinds is cited.
NOTES = (
    (("article",), "More primary article evidence would improve the answer."),
    (("transfer",), "A confirmed-transfer match would strengthen historical comparison."),
    (("stock_path", "match_result"), "Fresh stock and match-result context would reduce market-context uncertainty."),
    ((), "Newer high-credibility reports or official club disclosures can overturn the current read."),
)


def documents(kind: str, rows: DataFrame, title: Column, body: Column, **facts: Column) -> DataFrame:
    """Rows as evidence documents of one kind: doc_id, doc_type, title, text and whichever of club, player, reporter, source and
    published_at are given. Documents of several kinds go together with unionByName."""
    empty = {c: F.lit(None).cast("string") for c in ENTITIES} | {"published_at": F.lit(None).cast("timestamp")}
    cols = {k: c.cast("timestamp" if k == "published_at" else "string") for k, c in (empty | facts).items()}
    made = rows.select(F.lit(kind).alias("doc_type"), text.squeeze(title).alias("title"), text.squeeze(body).alias("text"), *(c.alias(k) for k, c in cols.items()))
    when = F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    return made.withColumn("doc_id", text.stable_id(F.col("doc_type"), F.col("title"), F.col("text"), when))


def lacking(types: Column) -> Column:
    """Notes for an answer whose citations have these kinds (a list)."""
    notes = [F.when(~F.arrays_overlap(types, F.array(*map(F.lit, kinds))), note) if kinds else F.lit(note) for kinds, note in NOTES]
    return F.array_compact(F.array(*notes))


def cited(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Each answer (q) with its number of citations and the notes on what it lacks. hits: q, doc, doc_type."""
    g = hits.groupBy("q").agg(F.count(F.lit(1)).alias("n_citations"), F.collect_set("doc_type").alias("types"))
    j = answers.join(g.hint("merge"), "q", "left")
    return j.select("q", F.coalesce("n_citations", F.lit(0)).cast("bigint").alias("n_citations"), lacking(F.coalesce("types", F.array().cast("array<string>"))).alias("notes"))


def entity_rows(hits: DataFrame, keep: list[str]) -> DataFrame:
    """One row (kind, value) per entity that a hit names."""
    pairs = F.array(*(F.struct(F.lit(c).alias("kind"), F.trim(F.col(c).cast("string")).alias("value")) for c in ENTITIES))
    return hits.select(*keep, F.inline(pairs)).where("value is not null and value <> ''")


def counted(rows: DataFrame) -> DataFrame:
    """How often each (kind, value) was seen and when last; a batch, or a stream in complete or update mode."""
    return rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seen_at").alias("last_seen"))


def counters_merged(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Counters so far with those of a new run added."""
    return stored.unionByName(arrived).groupBy("kind", "value").agg(F.sum("n").alias("n"), F.max("last_seen").alias("last_seen"))


def unwrapped(articles: DataFrame, url_map: DataFrame) -> DataFrame:
    """Articles whose wrapped url is in the landed map (url, decoded) get the decoded one, keep the old as original_url, take the
    source from the title's suffix and a confidence of at least 0.68. Maps that lead to a wrapped address are not used."""
    usable = url_map.select("url", text.squeeze(F.col("decoded")).alias("decoded")).where((F.col("decoded") != "") & ~F.col("decoded").rlike(WRAPPED)).groupBy("url").agg(F.min("decoded").alias("decoded"))
    j = articles.join(usable.hint("merge"), "url", "left")
    found = F.col("decoded").isNotNull() & F.col("url").rlike(WRAPPED)
    suffix = text.publisher_suffix(F.col("title"))
    changed = {
        "original_url": F.when(found, F.col("url")),
        "source": F.when(found & (suffix != ""), suffix).otherwise(F.col("source")),
        "confidence": F.when(found, F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.68))).otherwise(F.col("confidence")),
        "url": F.when(found, F.col("decoded")).otherwise(F.col("url")),
    }
    return j.withColumns(changed).drop("decoded")


def selected_sources(sources: DataFrame, keys: list[str], club: str | None = None) -> DataFrame:
    """The sources (key, club_keys) with the given keys, for one club if named; a source without clubs is for all. A key that no
    source has ends the job."""
    asked = sources.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    known = asked.join(sided(sources.where(F.col("key").isin(keys)).withColumn("_known", F.lit(True))), "key", "left")
    checked = known.where(F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown source: "), F.col("key"))).cast("boolean"))).drop("_known")
    if club is None:
        return checked
    return checked.where(F.array_contains("club_keys", club) | (F.size(F.coalesce("club_keys", F.array().cast("array<string>"))) == 0))
