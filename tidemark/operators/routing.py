"""Free-text questions: the names in them, what they ask for, and the signal they are about.

questions: q, question. names: name, a dimension of clubs, reporters or players. A name is in a question as a phrase, by all
of its words of three letters or more, or by some of them, in that order; repeated words count once. Names are counted and
broadcast while they are few, so that questions stay where they lie: a word that most of them have would gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.storage import sided, written

LEAST_LETTERS = 3


def _padded(c: Column | str) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def _asked(questions: DataFrame) -> DataFrame:
    norm = text.alnum_ascii(F.col("question"))
    return questions.select("q", norm.alias("asked"), F.array_distinct(F.split(norm, " ")).alias("asked_words"))


def _named(names: DataFrame) -> DataFrame:
    norm = text.alnum_ascii(F.col("name"))
    words = F.array_distinct(F.split(norm, " "))
    long = F.filter(words, lambda w: F.char_length(w) >= LEAST_LETTERS)
    return names.select("name", norm.alias("norm"), long.alias("long"), F.when(F.size(long) > 0, long).otherwise(words).alias("keys")).where("norm <> ''").distinct()


def mentions(questions: DataFrame, names: DataFrame) -> DataFrame:
    """q, name, score and place of the names that are there as a phrase or by all long words. Each name is looked up by the
    rarest of its words alone, so a first name that many share makes no pairs."""
    n = _named(names)
    pieces = n.select("name", F.explode("keys").alias("key"))
    spread = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n_names"))
    rarest = pieces.join(spread.hint("merge"), "key").groupBy("name").agg(F.min_by("key", F.struct("n_names", "key")).alias("key"))
    keyed = n.join(rarest.hint("merge"), "name")
    q = _asked(questions)
    pairs = q.withColumn("key", F.explode("asked_words")).join(sided(written(keyed, "routing-keys")), "key")
    phrase = F.instr(_padded("asked"), _padded("norm"))
    places = F.array_min(F.transform("long", lambda w: F.instr(_padded("asked"), _padded(w))))
    every = (F.size("long") > 0) & (F.size(F.array_except("long", "asked_words")) == 0)
    score = F.when(phrase > 0, 100 + F.char_length("norm")).when(every, 70 + F.size("long"))
    return pairs.select("q", "name", score.alias("score"), F.when(phrase > 0, phrase).otherwise(places).alias("place")).where("score is not null")


def best_name(questions: DataFrame, names: DataFrame) -> DataFrame:
    """q and the name that fits best; of equal ones the first by spelling. A single shared word decides only between names that
    nothing else speaks for, so the first name that has the word stands for all; names of three or more words can share two."""
    n = _named(names)
    words = _asked(questions).select("q", F.explode("asked_words").alias("word"))
    first = n.select("name", F.explode("long").alias("word")).groupBy("word").agg(F.min("name").alias("name"))
    single = words.join(sided(written(first, "routing-first")), "word").select("q", "name", F.lit(1).cast("bigint").alias("score"))
    wide = n.where(F.size("long") > 2).select("name", F.explode("long").alias("word"))
    several = words.join(sided(written(wide, "routing-wide")), "word").groupBy("q", "name").agg(F.count(F.lit(1)).alias("score")).where("score > 1")
    whole = mentions(questions, names).select("q", "name", F.col("score").cast("bigint").alias("score"))
    found = whole.unionByName(several).unionByName(single)
    return found.groupBy("q").agg(F.min_by("name", F.struct(-F.col("score"), "name")).alias("name"))


def clubs(questions: DataFrame, names: DataFrame) -> DataFrame:
    """q, club and other_club: the first two clubs by place, or the one that fits best."""
    by = Window.partitionBy("q").orderBy("place", "name")
    two = mentions(questions, names).withColumn("k", F.row_number().over(by)).where("k <= 2").groupBy("q").agg(F.min_by("name", "k").alias("first"), F.max_by("name", "k").alias("second"), F.max("k").alias("n"))
    best = best_name(questions, names)
    both = best.join(two.hint("merge"), "q", "left")
    several = F.coalesce(F.col("n") > 1, F.lit(False))
    return both.select("q", F.when(several, F.col("first")).otherwise(F.col("name")).alias("club"), F.when(several, F.col("second")).alias("other_club"))


def route(questions: DataFrame, club_names: DataFrame, reporter_names: DataFrame, player_names: DataFrame, latest_season: str) -> DataFrame:
    """q, intent and the names that the intent takes: club, other_club, reporter, player, season."""
    found = questions.select("q", "question").join(clubs(questions, club_names).hint("merge"), "q", "left")
    for kind, names in (("reporter", reporter_names), ("player", player_names)):
        found = found.join(best_name(questions, names).withColumnRenamed("name", kind).hint("merge"), "q", "left")
    norm = text.alnum_ascii(F.col("question"))
    has = lambda *words: F.coalesce(norm.rlike("|".join(words)), F.lit(False))
    club, other, reporter, player = (F.col(c).isNotNull() for c in ("club", "other_club", "reporter", "player"))
    intent = (
        F.when(other & (has("compare", " versus ", " vs ", " v ") | F.contains(_padded(norm), F.lit(" and "))), "compare_clubs")
        .when(reporter, "reporter_profile")
        .when(club & has("reporter", "journalist", "source", "credibility"), "club_reporters")
        .when(player & has("similar"), "similar_historical_cases")
        .when(player, "explain_rumor")
        .when(club & has("match", "result", "stock", "price"), "match_stock_context")
        .when(club & has("confirmed", "transfer", "past", "history"), "confirmed_transfers")
        .when(club, "current_signals_for_club")
        .otherwise("unknown")
    )
    asked_season = F.regexp_extract("question", r"\b(20\d{2}-\d{2})\b", 1)
    takes = {
        "club": ("compare_clubs", "club_reporters", "match_stock_context", "confirmed_transfers", "current_signals_for_club"),
        "other_club": ("compare_clubs",),
        "reporter": ("reporter_profile",),
        "player": ("similar_historical_cases", "explain_rumor"),
    }
    routed = found.withColumn("intent", intent)
    kept = [F.when(F.col("intent").isin(*intents), F.col(c)).alias(c) for c, intents in takes.items()]
    season = F.when(F.col("intent") == "confirmed_transfers", F.when(asked_season != "", asked_season).otherwise(F.lit(latest_season)))
    return routed.select("q", "intent", *kept, season.alias("season"))


def signal_of(asked: DataFrame, signals: DataFrame) -> DataFrame:
    """q and the signal each question (q, player, club) is about: the player's strongest if it is of the club asked for, else the
    strongest of the club, else of all. signals: signal_id, player, club, strength."""
    best = F.min_by(F.struct("signal_id", "club"), F.struct(-F.col("strength"), "signal_id"))
    of_player = signals.groupBy("player").agg(best.alias("p"))
    of_club = signals.where("club is not null").rollup("club").agg(best.alias("c")).withColumn("club_key", F.coalesce("club", F.lit(""))).select("club_key", "c")
    j = asked.join(of_player.hint("merge"), "player", "left").withColumn("club_key", F.coalesce("club", F.lit(""))).join(of_club.hint("merge"), "club_key", "left")
    fits = F.col("p").isNotNull() & (F.col("club").isNull() | (F.col("club") == F.col("p.club")))
    return j.select("q", F.when(fits, F.col("p.signal_id")).otherwise(F.col("c.signal_id")).alias("signal_id"), F.when(fits, "player").when(F.col("club").isNotNull(), "club").otherwise("all").alias("found_by"))
