"""Landed rows made into the engine's tables: articles, window and dated transfers, club ids, and what is new in a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, scoring, text
from tidemark.storage import sided


def normalised_articles(rows: DataFrame, clubs: Column | None = None, labelled: bool = False) -> DataFrame:
    """Articles in their normal form. rows: title, url, published_at (text), source and, where known, snippet, body_text,
    provider, journalist, player, club, language, extraction_confidence, crawl_method. clubs: array of (name, aliases), or of `text.club_labels` if `labelled`."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    clean = lambda c: text.squeeze(F.coalesce(have(c).cast("string"), F.lit("")))
    n = rows.select("*", *(clean(c).alias(f"_{c}") for c in ("title", "url", "snippet", "body_text", "club", "player", "language", "provider", "crawl_method")))
    n = n.withColumns({"_source": text.source_name(have("source"), have("provider"), have("url")), "_seen": dates.parse_timestamp(F.col("published_at").cast("string")), "_normal": F.when(F.col("_url") != "", text.canonical_url(F.col("_url"))).otherwise("")})
    stamp = F.coalesce(F.date_format("_seen", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit(""))
    named = text.named_clubs(F.concat_ws(" ", "_title", "_snippet", "_body_text", "_club"), clubs, labelled) if clubs is not None else F.array().cast("array<string>")
    blank = lambda c, other: F.when(F.col(c) == "", other).otherwise(F.col(c))
    return n.select(
        text.stable_id(F.col("_normal"), F.lower("_title"), stamp, F.lower("_source")).alias("article_id"),
        F.col("_seen").alias("published_at"),
        F.col("_source").alias("source"),
        text.reporter(have("journalist"), F.col("_source")).alias("journalist"),
        F.col("_title").alias("title"),
        F.col("_url").alias("url"),
        F.col("_normal").alias("normalized_url"),
        blank("_language", "English").alias("language"),
        F.col("_body_text").alias("body_text"),
        F.col("_snippet").alias("snippet"),
        named.alias("club_candidates"),
        F.when(F.col("_player") != "", F.array("_player")).otherwise(F.array().cast("array<string>")).alias("player_candidates"),
        scoring.clamp(F.coalesce(have("extraction_confidence").cast("string").try_cast("double"), F.lit(0.5))).alias("extraction_confidence"),
        blank("_provider", F.substring_index("_source", " / ", 1)).alias("provider"),
        blank("_crawl_method", "legacy").alias("crawl_method"),
        F.col("_club").alias("club"),
    )


ARTICLE_KEY = ["normalized_url", "title_key", "day"]


def with_article_key(articles: DataFrame) -> DataFrame:
    """Articles are one when url, lower-case title and day of publication are."""
    return articles.withColumns({"title_key": F.lower("title"), "day": F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit(""))})


def new_only(arrived: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """What has arrived and is not stored, one row per key (the smallest by all columns)."""
    fresh = arrived.join(stored.select(*keys).hint("merge"), keys, "left_anti")
    others = [c for c in fresh.columns if c not in keys]
    first = fresh.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_first")) if others else fresh.select(*keys).distinct()
    return first.select(*keys, *(["_first.*"] if others else []))


def chosen_club(candidates: Column, title: Column, snippet: Column, explicit: Column) -> Column:
    """The club an article is about: the given one, the only candidate, else the candidate that the title (2 points) and the
    snippet (1) name most, by spelling on a tie; the first candidate if none is named."""
    t, s = text.alnum_folded(title), text.alnum_folded(snippet)
    points = lambda n: F.when((n != "") & F.contains(t, n), 2).otherwise(0) + F.when((n != "") & F.contains(s, n), 1).otherwise(0)
    scored = F.transform(candidates, lambda c: F.struct((-points(text.alnum_folded(c))).alias("p"), c.alias("name")))
    best = F.array_min(scored)
    found = F.when(best["p"] < 0, best["name"]).otherwise(F.get(candidates, F.lit(0)))
    return F.coalesce(F.nullif(text.squeeze(explicit), F.lit("")), found, F.lit(""))


#: What fields of a claim may hold.
DIRECTIONS = ("in", "out", "unclear")
STAGES = ("linked", "talks", "bid", "advanced", "agreed", "medical", "official", "unclear")
TYPES = ("permanent", "loan", "loan_with_option", "option", "unclear")


def validated_claims(claims: DataFrame) -> DataFrame:
    """Claims with values outside the known ones made `unclear`, confidence after penalties, and notes on what was wrong.
    claims: direction, stage, transfer_type, related, player, club, title, confidence and whatever else."""
    known = lambda c: F.coalesce(F.nullif(F.lower(text.squeeze(F.col(c))), F.lit("")), F.lit("unclear"))
    odd = {c: ~known(c).isin(*values) for c, values in (("direction", DIRECTIONS), ("stage", STAGES), ("transfer_type", TYPES))}
    related = F.coalesce("related", F.lit(False))
    no_player, no_club = (F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c in ("player", "club"))
    notes = F.array_compact(F.array(*(F.when(odd[c], f"invalid_{c}") for c in odd), F.when(~related, "not_transfer_related"), F.when(no_player, "missing_player"), F.when(no_club, "missing_club")))
    live = F.contains(text.alnum_folded(F.col("title")), F.lit("live"))
    score = F.coalesce("confidence", F.lit(0.0)) * F.when(no_player | no_club, 0.7).otherwise(1.0) * F.when(related, 1.0).otherwise(0.4) * F.when(live, 0.6).otherwise(1.0)
    value = {c: F.when(odd[c], "unclear").otherwise(known(c)) for c in odd}
    value |= {c: F.when(related, value[c]).otherwise("unclear") for c in ("direction", "stage")}
    return claims.withColumns({**value, "confidence": scoring.clamp(score), "notes": notes})


def club_ids(clubs: DataFrame, names: DataFrame) -> DataFrame:
    """club_id and canonical name where a club's name or code holds one of the known names, or the other way round; the last
    canonical name by spelling if there are several. clubs: club_id, name, club_code; names: alias, canonical. What is part of
    another text shares its first letters with a stretch of it, so both are looked up by three letters (fewer, if a name is
    shorter) and then compared; nothing meets everything."""
    grams = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, n)))))
    start = lambda c: F.left(c, F.lit(3))
    options = F.array(F.lower(F.coalesce("name", F.lit(""))), F.lower(F.replace(F.coalesce("club_code", F.lit("")), F.lit("-"), F.lit(" "))))
    candidates = clubs.select("club_id", F.explode(F.array_distinct(options)).alias("candidate")).where("candidate <> ''")
    known = names.select(F.lower("alias").alias("alias"), "canonical").where("alias <> ''").distinct()
    longer = candidates.withColumn("key", F.explode(grams(F.col("candidate")))).join(known.withColumn("key", start(F.col("alias"))).hint("merge"), "key").where(F.contains("candidate", "alias"))
    shorter = candidates.withColumn("key", start(F.col("candidate"))).join(known.withColumn("key", F.explode(grams(F.col("alias")))).hint("merge"), "key").where(F.contains("alias", "candidate"))
    both = longer.select("club_id", "canonical").unionByName(shorter.select("club_id", "canonical"))
    return both.groupBy("club_id").agg(F.max("canonical").alias("club"))


def window_transfers(rows: DataFrame, names: DataFrame, first: str, last: str) -> DataFrame:
    """Transfers of a source that knows windows only: dates are the window's first day, cleaned fees are millions, `loan` in
    the fee makes a loan. rows: club_name, season, year, player_name, age, position, club_involved_name, fee, fee_cleaned,
    transfer_movement, transfer_period. names: alias (lower case), a dimension of the clubs that are kept."""
    season = dates.canonical_season(F.col("season"), F.col("year"))
    # Rows stay where they lie, if there are few names: clubs are few keys, so a merge gathers all rows in as many tasks.
    r = rows.withColumn("_club", F.trim("club_name")).join(sided(names.select(F.lower("alias").alias("_a")).distinct()), F.lower("_club") == F.col("_a"), "left_semi")
    r = r.withColumn("season", season).where(dates.season_in_range(F.col("season"), F.lit(first), F.lit(last)))
    way, other = F.lower(F.trim("transfer_movement")), F.trim("club_involved_name")
    direction = F.when(way.isin("in", "out"), way).otherwise(F.raise_error(F.concat(F.lit("unknown movement: "), F.col("transfer_movement"))).cast("string"))
    year = F.col("year").try_cast("int")
    day = F.when(F.lower(F.trim("transfer_period")) == "winter", F.make_date(year + 1, F.lit(1), F.lit(1))).otherwise(F.make_date(year, F.lit(7), F.lit(1)))
    loan = F.contains(F.lower(F.coalesce("fee", F.lit(""))), F.lit("loan"))
    return r.select(
        day.alias("date"),
        "season",
        F.col("_club").alias("club"),
        F.trim("player_name").alias("player"),
        direction.alias("direction"),
        F.when(way == "in", other).otherwise(F.col("_club")).alias("from_club"),
        F.when(way == "in", F.col("_club")).otherwise(other).alias("to_club"),
        F.col("age").try_cast("double").alias("age"),
        scoring.money_from_millions(F.col("fee_cleaned")).alias("transfer_fee_eur"),
        F.when(loan, "loan").otherwise("permanent").alias("transfer_type"),
        loan.alias("is_loan"),
    )


def dated_transfers(moves: DataFrame, players: DataFrame, ids: DataFrame, first: str, last: str, as_of: Column) -> DataFrame:
    """Transfers with exact dates, a row for each known side: in for the buyer, out for the seller; one row per date, club,
    player and direction. Moves after `as_of` or outside the seasons are left out. moves: move_id, player_id, player_name,
    transfer_date, transfer_season, from_club_id, from_club_name, to_club_id, to_club_name, fee, market_value, kind. players:
    player_id, date_of_birth, position; ids: club_id, club."""
    day = F.to_date("transfer_date")
    m = moves.withColumns({"date": day, "season": F.coalesce(F.nullif(dates.canonical_season(F.col("transfer_season")), F.lit("")), dates.season(day))})
    m = m.where((F.col("date") <= as_of) & dates.season_in_range(F.col("season"), F.lit(first), F.lit(last)))
    side = lambda way, column: F.struct(F.lit(way).alias("direction"), F.col(column).alias("club_id"))
    each = m.select("*", F.inline(F.array(side("in", "to_club_id"), side("out", "from_club_id"))))
    known = each.join(ids.hint("merge"), "club_id").join(players.hint("merge"), "player_id", "left")
    buys = F.col("direction") == "in"
    rows = known.select(
        "date", "season", "club", F.col("player_name").alias("player"), "direction", "move_id",
        F.when(buys, F.col("from_club_name")).otherwise(F.col("club")).alias("from_club"),
        F.when(buys, F.col("club")).otherwise(F.col("to_club_name")).alias("to_club"),
        dates.age_on(F.to_date("date_of_birth"), F.col("date")).alias("age"),
        "position", F.col("market_value").alias("market_value_eur"), F.col("fee").alias("transfer_fee_eur"), F.col("kind").alias("transfer_type"), F.contains("kind", F.lit("loan")).alias("is_loan"),
    )
    key = ["date", "club", "player", "direction"]
    others = [c for c in rows.columns if c not in (*key, "move_id")]
    return rows.groupBy(*key).agg(F.min(F.struct("move_id", *others)).alias("_f")).select(*key, *(F.col(f"_f.{c}").alias(c) for c in others))


def by_loan_policy(moves: DataFrame, policy: str) -> DataFrame:
    """include, exclude or only loans."""
    tests = {"include": F.lit(True), "exclude": ~F.col("is_loan"), "only": F.col("is_loan")}
    if policy not in tests:
        raise ValueError(f"unknown loan policy: {policy}")
    return moves.where(tests[policy])


def transfer_view(moves: DataFrame, key: list[str], policy: str = "include", least_fee: float = 0.0, sort: str = "date", start: int = 0, limit: int | None = None) -> DataFrame:
    """Moves with a fee of `least_fee` or more, by date, fee or market-value, from place `start` on, at most `limit` of them."""
    order = {"date": [F.col("date")], "fee": [F.desc("transfer_fee_eur")], "market-value": [F.desc("market_value_eur")]}[sort]
    rows = by_loan_policy(moves, policy).where(F.coalesce("transfer_fee_eur", F.lit(0.0)) >= least_fee).orderBy(*order, *key)
    rows = rows.offset(start) if start else rows
    return rows.limit(limit) if limit is not None else rows


#: Columns of a clean transfer file, in order.
CLEAN_FIELDS = ["date", "season", "club", "player", "direction", "from_club", "to_club", "age", "position", "market_value_eur", "transfer_fee_eur", "wage_eur_annual", "transfer_type", "is_loan", "source", "source_url"]
