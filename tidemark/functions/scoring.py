"""Scores as column expressions. Weights are fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAGE_SCORES = {"official": 0.95, "medical": 0.9, "agreed": 0.82, "advanced": 0.72, "bid": 0.6, "talks": 0.55, "linked": 0.48, "unclear": 0.4}
ARTICLE_SCORES = {"exclusive": 0.85, "official": 0.9, "report": 0.65, "aggregate": 0.45, "live_blog": 0.2, "analysis": 0.35, "unclear": 0.5}
CREDIBILITY_WEIGHTS = {"source": 0.25, "journalist": 0.20, "conversion": 0.20, "club": 0.10, "stage": 0.15, "article": 0.05, "timing": 0.05}
QUEUE_STAGES = {"official": 1.0, "medical": 0.92, "agreed": 0.86, "advanced": 0.76, "bid": 0.62, "talks": 0.5, "linked": 0.28}
STRONG_STAGES = ("advanced", "agreed", "medical", "official")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def rounded(c: Column, digits: int = 4) -> Column:
    """Rounded at output; a hair is added so that sums that stand for an exact half round alike everywhere."""
    return F.round(c + 1e-9, digits)


def lookup(c: Column, table: dict, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), F.lit(default))


def _or(c: Column, default: float) -> Column:
    """A missing or zero value takes the default."""
    return F.when(c.isNull() | (c == 0), default).otherwise(c)


def transfer_quality(direction: Column, market: Column, fee: Column, wage: Column, age: Column) -> Column:
    market, fee, wage, age, buys = _or(market, 0.0), _or(fee, 0.0), _or(wage, 0.0), _or(age, 27.0), direction == "in"
    gap = F.when(market > 0, F.when(buys, market - fee).otherwise(fee - market) / market).otherwise(0.0)
    years = F.when(buys, 1.0 - F.abs(age - 24.0) / 12.0).otherwise(0.65 + F.greatest(age - 27.0, F.lit(0.0)) / 12.0)
    return clamp(0.45 * clamp(0.5 + gap / 2.0) + 0.30 * clamp(years) + 0.25 * (1.0 - 0.35 * clamp(wage / 25_000_000.0)))


def fee_to_market(fee: Column, market: Column) -> Column:
    return F.when((fee > 0) & (market > 0), fee / market).otherwise(0.0)


def transfer_indicator(direction: Column, market: Column, fee: Column, wage: Column, age: Column, loan: Column) -> Column:
    quality, buys, ratio = rounded(transfer_quality(direction, market, fee, wage, age)), direction == "in", F.round(fee_to_market(fee, market), 4)
    years = F.coalesce(age, F.lit(27.0))
    money = F.when(ratio <= 0, 0.5).when(buys, clamp(1.15 - ratio)).otherwise(clamp(0.5 + (ratio - 1.0) / 2.0))
    stage = F.when(buys, 1.0 - F.abs(years - 24.0) / 12.0).otherwise(0.55 + F.greatest(years - 26.0, F.lit(0.0)) / 14.0)
    return clamp(0.50 * quality + 0.30 * money + 0.20 * clamp(stage) - F.when(loan, 0.08).otherwise(0.0))


def smoothed(matched: Column, total: Column, baseline, weight: float = 5.0) -> Column:
    return (matched + baseline * weight) / (total + weight)


def fee_closeness(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), 1 - F.abs(a - b) / F.greatest(a, b)).otherwise(0.0)


def direction_sign(c: Column) -> Column:
    return F.when(c == "in", 1.0).when(c == "out", -1.0).otherwise(0.0)


def blended(prob_positive, prob_negative, direction, transfer, credibility, stage, stock) -> Column:
    """-100 to 100."""
    raw = 0.45 * (prob_positive - prob_negative) + 0.20 * direction_sign(direction) * transfer + 0.15 * 2 * (credibility - 0.5) + 0.10 * 2 * (stage - 0.5) + 0.10 * 2 * (stock - 0.5)
    return F.round(clamp(raw, -1.0, 1.0) * 100, 2)


def blended_label(score: Column, band: float = 12.0) -> Column:
    return F.when(score >= band, "positive").when(score <= -band, "negative").otherwise("neutral")


def event_strength(credibility, stage, sources, headlines) -> Column:
    return 0.45 * credibility + 0.25 * stage + 0.15 * F.least(F.lit(1.0), sources / 4) + 0.15 * F.least(F.lit(1.0), headlines / 4)


def confidence_tier(strength, headlines, sources, direct) -> Column:
    return (
        F.when((strength >= 0.68) & (sources >= 3) & (headlines >= 2) & (direct >= 2), "broad_consensus")
        .when((strength >= 0.56) & (sources >= 2) & (direct >= 1), "strong")
        .when((strength >= 0.44) & ((sources >= 2) | (headlines >= 2)), "developing")
        .otherwise("thin")
    )


def consensus(direction_share, stage_share, sources, direct_share, unique_share) -> Column:
    return 0.30 * direction_share + 0.25 * stage_share + 0.20 * F.least(F.lit(1.0), sources / 4) + 0.15 * direct_share + 0.10 * unique_share


def consensus_label(c: Column) -> Column:
    return F.when(c >= 0.82, "Broad alignment").when(c >= 0.68, "Aligned").when(c >= 0.52, "Developing").otherwise("Mixed")


def score_status(c: Column) -> Column:
    return F.when(c >= 0.82, "strong").when(c >= 0.62, "usable").when(c >= 0.42, "watch").otherwise("needs_refresh")


def stance(score: Column) -> Column:
    return F.when(score >= 0.35, "bullish").when(score <= -0.35, "bearish").when(F.abs(score) <= 0.12, "neutral").otherwise("watch")


def stance_value(c: Column) -> Column:
    return F.when(c == "bullish", 1).when(c == "bearish", -1).otherwise(0)


def parse_number(c: Column, default: float | None = None) -> Column:
    """A number from text; the default for blank or unreadable text."""
    found = F.trim(c.cast("string")).try_cast("double")
    return found if default is None else F.coalesce(found, F.lit(default))


def parse_flag(c: Column) -> Column:
    """true for 1, true, yes and y."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def money_from_millions(c: Column) -> Column:
    """Euros from a cleaned fee in millions; NULL for blank and NA."""
    raw = F.trim(c)
    return F.when((raw != "") & (F.upper(raw) != "NA"), raw.try_cast("double") * 1_000_000)


def log_money(c: Column) -> Column:
    return F.when(c > 0, F.log1p(c)).otherwise(0.0)


def market_minus_fee(fee: Column, market: Column) -> Column:
    m, f = F.coalesce(market, F.lit(0.0)), F.coalesce(fee, F.lit(0.0))
    return F.when((m <= 0) & (f <= 0), 0.0).otherwise(m - f)


def source_prior(source: Column, priors: dict[str, float], default: float = 0.5) -> Column:
    """The largest prior of the known names that are part of the source's name; the default at least."""
    found = [F.when(F.contains(F.lower(source), F.lit(name.lower())), score).otherwise(0.0) for name, score in priors.items()]
    return clamp(F.greatest(F.lit(default), *found) if found else F.lit(default))


def text_credibility(text: Column, source: Column, priors: dict[str, float], keywords: dict[str, float], default: float = 0.5) -> Column:
    """The largest prior of names in source or text, moved by the keywords in the text."""
    has = lambda c, name: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(name.lower()))
    base = F.greatest(F.lit(default), *(F.when(has(source, n) | has(text, n), v).otherwise(0.0) for n, v in priors.items()), F.lit(0.0))
    return clamp(base + sum((F.when(has(text, k), v).otherwise(0.0) for k, v in keywords.items()), F.lit(0.0)))


def rumor_strength(text: Column, credibility: Column) -> Column:
    """Credibility and urgency; fixed words tell urgent texts."""
    urgent = F.lower(F.coalesce(text, F.lit(""))).rlike("medical|agreement|signed")
    return clamp(0.65 * credibility + 0.35 * F.when(urgent, 1.0).otherwise(0.4))


def article_kind(title: Column, source: Column, stage: Column) -> Column:
    """exclusive, live_blog, official, aggregate, analysis or report, the first that fits."""
    t, s = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(source, F.lit("")))
    has = lambda *words: t.rlike("|".join(words))
    return (
        F.when(has("exclusive") | F.contains(s, F.lit("exclusive")), "exclusive")
        .when(has("live", "as it happened"), "live_blog")
        .when(has("official") | F.coalesce(stage == "official", F.lit(False)), "official")
        .when(has("rumours", "rumors", "latest", "roundup"), "aggregate")
        .when(F.contains(t, F.lit("|")), "analysis")
        .otherwise("report")
    )


#: Phrases of titles that make a rumor stronger.
PHRASE_BOOSTS = {"here we go": 0.15, "agreement": 0.10, "medical": 0.10, "confirm": 0.08, "complete": 0.08, "talks": 0.04, "interested": 0.02}


def rumor_indicator(credibility: Column, strength: Column, count: Column, title: Column) -> Column:
    told = sum((F.when(F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(p)), b).otherwise(0.0) for p, b in PHRASE_BOOSTS.items()), F.lit(0.0))
    parts = 0.45 * F.coalesce(credibility, F.lit(0.5)) + 0.35 * F.coalesce(strength, F.lit(0.5)) + 0.20 * clamp(F.coalesce(count, F.lit(1.0)) / 4.0)
    return clamp(parts + told)


def component_indicator(credibility: Column, conversion: Column, stage: Column, article: Column, timing: Column) -> Column:
    """The rumor indicator of a scored claim."""
    or_ = lambda c, d: F.coalesce(c, F.lit(d))
    return clamp(0.40 * or_(credibility, 0.5) + 0.20 * or_(conversion, 0.5) + 0.20 * or_(stage, 0.4) + 0.10 * or_(article, 0.5) + 0.10 * or_(timing, 0.5))


def entity_match(score: Column, ambiguous: Column) -> Column:
    return clamp(F.coalesce(score, F.lit(0.0)) / 1.2) * F.when(ambiguous, 0.85).otherwise(1.0)


def expected_impact(strength: Column, quality: Column, direction: Column) -> tuple[Column, Column]:
    """(expected abnormal return, confidence) of a rumor by rule."""
    raw = (strength - 0.5) * 0.05 + (quality - 0.5) * 0.06 * F.when(direction == "in", 1.0).otherwise(0.65)
    return F.greatest(F.lit(-0.08), F.least(F.lit(0.08), raw)), clamp(0.35 + 0.45 * strength)


def result_sentiment(result: Column, goals_for: Column, goals_against: Column) -> Column:
    """positive, negative or neutral, by the result's name, else by goals."""
    named = F.lower(F.trim(F.coalesce(result, F.lit(""))))
    return (
        F.when(named.isin("w", "win", "won"), "positive")
        .when(named.isin("l", "loss", "lost"), "negative")
        .when(named.isin("d", "draw"), "neutral")
        .when(goals_for > goals_against, "positive")
        .when(goals_for < goals_against, "negative")
        .otherwise("neutral")
    )


def blended_confidence(score: Column, credibility: Column) -> Column:
    return clamp(0.30 + 0.45 * F.abs(score) / 100.0 + 0.25 * F.coalesce(credibility, F.lit(0.0)))


def queue_score(direct: Column, credibility: Column, confidence: Column, sources: Column, stage: Column) -> Column:
    """How much a signal is worth a look: directness, credibility, confidence, up to five sources, strong stages."""
    return F.when(direct, 2.0).otherwise(0.0) + credibility + confidence + F.least(sources, F.lit(5.0)) * 0.08 + F.when(stage.isin(*STRONG_STAGES), 0.35).otherwise(0.0)
