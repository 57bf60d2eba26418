"""How well answers are grounded: six dimensions of each run from its answer, its citations and its searches.

answers: run, text, warnings and notes (how many of either it gives). citations: run, text, source, day (NULL: undated), strength
(0 to 1). searches: run, purpose, method, hits. All three are counted as rows, so no run gathers in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, scoring, text

#: The dimensions with their weights, the score below which each has a warning, and the warning.
DIMENSIONS = (
    ("answer_support", 0.26, 0.55, "answer terms missing in citations"),
    ("citation_strength", 0.18, 0.55, "weak citations"),
    ("source_diversity", 0.14, 0.5, "narrow source set"),
    ("retrieval_health", 0.18, None, "searches without evidence"),
    ("citation_freshness", 0.12, 0.5, "old citations"),
    ("uncertainty_disclosure", 0.12, 0.5, "warnings and notes missing"),
)
#: The score that a run without a dated citation has for freshness.
UNDATED = 0.45
#: The scores below which a dimension asks for work, in the order of the advice.
ADVICE = (("answer_support", 0.65, "improve_grounding"), ("source_diversity", 0.6, "more_sources"), ("retrieval_health", 0.65, "rebuild_index"), ("citation_freshness", 0.55, "refresh_articles"))


def _support(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """run and the share of the answer's distinct words of four letters or more that a citation holds."""
    words = lambda rows, flag: rows.select("run", F.explode(text.tokens(F.col("text"))).alias("w")).where("char_length(w) > 3").distinct().withColumn(flag, F.lit(1))
    met = words(answers, "said").join(words(citations, "shown").hint("merge"), ["run", "w"], "left")
    return met.groupBy("run").agg(F.avg(F.coalesce("shown", F.lit(0))).alias("answer_support"))


def _cited(citations: DataFrame, as_of: Column) -> DataFrame:
    age = F.greatest(F.datediff(as_of, "day"), F.lit(0))
    g = citations.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("strength", F.lit(0.0))).alias("strength"), F.countDistinct(F.nullif(F.trim("source"), F.lit(""))).alias("sources"), F.avg(F.when(F.col("day").isNotNull(), age)).alias("age"))
    fresh = F.when(F.col("age").isNull(), UNDATED).otherwise(dates.citation_freshness(F.col("age")))
    return g.select("run", "n", scoring.clamp(F.col("strength")).alias("citation_strength"), F.least(F.lit(1.0), F.col("sources") / F.col("n") * 1.35).alias("source_diversity"), fresh.alias("citation_freshness"))


def _searched(searches: DataFrame) -> DataFrame:
    g = searches.groupBy("run").agg(F.count(F.lit(1)).alias("queries"), F.countDistinct("method").alias("methods"), F.sum("hits").alias("hits"), F.count_if(F.col("hits") == 0).alias("empty"))
    health = 0.35 * scoring.clamp(F.col("queries") / 5.0) + 0.35 * scoring.clamp(F.col("methods") / 3.0) + 0.30 * scoring.clamp(F.col("hits") / 10.0)
    return g.select("run", health.alias("retrieval_health"), "empty")


def audit(answers: DataFrame, citations: DataFrame, searches: DataFrame, as_of: Column) -> DataFrame:
    """A row per run: the six scores, their weighted sum (overall), its status, warnings and advice."""
    base = answers.groupBy("run").agg(F.sum("warnings").alias("warnings"), F.sum("notes").alias("notes"))
    j = base
    for part in (_support(answers, citations), _cited(citations, as_of), _searched(searches)):
        j = j.join(part.hint("merge"), "run", "left")
    disclosed = F.when(F.col("warnings") > 0, 0.45).otherwise(0.0) + F.when(F.col("notes") > 0, 0.55).otherwise(0.0)
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("answer_support", "citation_strength", "source_diversity", "retrieval_health")}
    j = j.withColumns({**zero, "citation_freshness": F.coalesce("citation_freshness", F.lit(UNDATED)), "uncertainty_disclosure": disclosed})
    scores = {name: scoring.rounded(F.col(name)) for name, *_ in DIMENSIONS}
    j = j.withColumns(scores)
    overall = sum((weight * F.col(name) for name, weight, *_ in DIMENSIONS), F.lit(0.0))
    low = [F.when((F.col("empty") > 0) if least is None else (F.col(name) < least), said) for name, _, least, said in DIMENSIONS]
    asks = [F.when(F.col(name) < least, said) for name, least, said in ADVICE]
    advice = F.array_compact(F.array(*asks))
    return j.withColumn("overall", scoring.rounded(overall)).select(
        "run",
        *scores,
        "overall",
        scoring.score_status(F.col("overall")).alias("status"),
        F.array_compact(F.array(*low)).alias("warnings"),
        F.when(F.size(advice) == 0, F.array(F.lit("usable"))).otherwise(advice).alias("advice"),
    )
