"""Labels and texts that reports and searches show: deals, summaries, numbers, dates, search queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What searches for a club, a deal or an event ask for besides names.
STORY_TERMS = "(transfer OR signing OR signed OR agreement OR talks OR medical OR loan)"
CLUB_TERMS = "(transfer OR signing OR signed OR agreement OR talks OR medical OR bid OR bids OR loan)"


def _known(c: Column, other: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))


def counterparty(role: Column, buyer: Column, seller: Column) -> Column:
    """The other side of a deal; blank for other roles."""
    return F.coalesce(F.when(role == "buyer", F.trim(seller)).when(role == "seller", F.trim(buyer)), F.lit(""))


def deal_path(buyer: Column, seller: Column) -> Column:
    return F.concat(_known(seller, "Unknown seller"), F.lit(" -> "), _known(buyer, "Unknown buyer"))


def comparison(club: Column, player: Column, label: Column, car: Column) -> Column:
    """A past case in one line; blank if there is none (player NULL)."""
    base = F.concat(F.trim(player), F.lit(" / "), F.trim(club), F.lit(" · "), _known(label, "unlabeled"))
    return F.coalesce(F.concat(base, F.when(car.isNotNull(), F.concat(F.lit(" · CAR "), F.format_string("%.4f", car))).otherwise("")), F.lit(""))


def signal_summary(tier: Column, role: Column, outlets: Column, direct: Column, other_side: Column, closest: Column) -> Column:
    """One sentence on a signal and one on its closest past case, if any."""
    base = F.concat(F.initcap(F.replace(tier, F.lit("_"), F.lit(" "))), F.lit(" "), _known(role, "target"), F.lit("-side event across "), outlets.cast("string"), F.lit(" outlets with "), direct.cast("string"), F.lit(" direct article"))
    base = F.concat(base, F.when(direct == 1, "").otherwise("s"), F.lit("; counterparty: "), _known(other_side, "counterparty unconfirmed"), F.lit("."))
    return F.concat(base, F.when(closest != "", F.concat(F.lit(" Closest historical comp: "), closest, F.lit("."))).otherwise(""))


def interpretation(observed: Column, predicted: Column, rumors: Column) -> Column:
    rows = F.concat(F.lit("; heuristic says "), predicted, F.lit("; "), F.coalesce(rumors, F.lit(0)).cast("string"), F.lit(" matched rumor/news rows."))
    seen = F.concat(F.lit("Observed "), observed, F.lit(" abnormal return"))
    return F.concat(F.coalesce(F.when(observed != "", seen), F.lit("No observed CAR label yet")), rows)


def number(c: Column, digits: int = 3) -> Column:
    """Fixed digits; `-` for nothing."""
    return F.when(c.isNull(), "-").otherwise(F.format_string(f"%.{digits}f", c.cast("double")))


def percent(c: Column, digits: int = 1) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.format_string(f"%.{digits}f%%", c.cast("double") * 100))


def _quoted(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit('"'), n, F.lit('"'))), " OR ")


def transfer_query(name: Column, aliases: Column) -> Column:
    """Search text for the deals of a club: names of five letters or more whose words have four or more."""
    names = F.array_distinct(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))))
    long = F.filter(names, lambda n: (F.char_length(F.replace(n, F.lit(" "), F.lit(""))) >= 5) & F.forall(F.split(n, " "), lambda w: F.char_length(w) >= 4))
    return F.concat(F.lit("("), _quoted(long), F.lit(f") {STORY_TERMS}"))


def club_query(name: Column, aliases: Column) -> Column:
    names = F.transform(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))), lambda n: F.trim(n))
    return F.concat(F.lit("("), _quoted(F.array_distinct(F.filter(names, lambda n: n != ""))), F.lit(f") {CLUB_TERMS}"))


def event_query(club: Column, player: Column) -> Column:
    """Search text for one deal."""
    part = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit('"'), c, F.lit('"')))
    return F.concat(F.concat_ws(" ", part(player), part(club)), F.lit(f" {STORY_TERMS}"))


#: What a date rests on.
PROXY_NOTE, NEWS_NOTE, WINDOW_NOTE, EXACT_NOTE = "proxy window date; not exact announcement date", "earliest credible news/article date", "source has transfer window timing", "exact or source-provided date"


def date_note(date_source: Column, day: Column, windowed: Column) -> Column:
    """What the date of an event rests on. windowed: the source knows windows only."""
    edge = F.date_format(day, "MM-dd").isin("07-01", "01-01")
    return F.when(date_source == "first_credible_news", NEWS_NOTE).when((date_source == "proxy_transfer_window") | edge, PROXY_NOTE).when(windowed, WINDOW_NOTE).otherwise(EXACT_NOTE)
