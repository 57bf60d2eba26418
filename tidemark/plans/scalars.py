"""Queries that put the column functions to work over whole tables: labels, search texts, dates, seasons, money and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, labels, scoring, text
from tidemark.sources import bindings as b
from tidemark.sources.tables import table

from .registry import query
from .sql_bindings import HEADLINES, PREDICTIONS, TRANSFERS

c = lambda name: F.col(name)  # noqa: E731  (columns need a session, so they are made inside the queries)


@query(
    "deal_labels",
    f"""WITH {PREDICTIONS}, p AS (
      SELECT case_id, target_role, predicted_label, actual_label, club, player, source, prediction_confidence, case_id % 6 AS outlets, case_id % 3 AS direct,
        CASE WHEN case_id % 4 = 0 THEN '' ELSE 'Buyer ' || (case_id % 9) END AS buyer, CASE WHEN case_id % 5 = 0 THEN NULL ELSE 'Seller ' || (case_id % 7) END AS seller,
        (['thin', 'developing', 'broad_consensus'])[case_id % 3 + 1] AS tier FROM predictions),
    q AS (SELECT *, coalesce(CASE target_role WHEN 'buyer' THEN seller WHEN 'seller' THEN buyer END, '') AS other FROM p)
    SELECT case_id, other AS counterparty, CASE WHEN coalesce(seller, '') = '' THEN 'Unknown seller' ELSE seller END || ' -> ' || CASE WHEN buyer = '' THEN 'Unknown buyer' ELSE buyer END AS path,
      CASE tier WHEN 'thin' THEN 'Thin' WHEN 'developing' THEN 'Developing' ELSE 'Broad Consensus' END || ' ' || target_role || '-side event across ' || outlets || ' outlets with ' || direct || ' direct article' || CASE WHEN direct = 1 THEN '' ELSE 's' END
        || '; counterparty: ' || CASE WHEN other = '' THEN 'counterparty unconfirmed' ELSE other END || '.' || CASE WHEN case_id % 2 = 0 THEN ' Closest historical comp: ' || player || ' / ' || club || ' · ' || actual_label || '.' ELSE '' END AS summary,
      CASE WHEN case_id % 3 = 0 THEN 'No observed CAR label yet' ELSE 'Observed ' || actual_label || ' abnormal return' END || '; heuristic says ' || predicted_label || '; ' || outlets || ' matched rumor/news rows.' AS reading,
      CASE WHEN case_id % 8 = 0 THEN '-' ELSE printf('%.3f', outlets / 7.0e0) END AS shown, CASE WHEN case_id % 8 = 0 THEN '-' ELSE printf('%.1f', outlets / 7.0e0 * 100) || '%' END AS share
    FROM q""",
)
def deal_labels(spark, sf_dir):
    """Other sides, paths and sentences of deals, and numbers as reports show them."""
    i = c("case_id")
    named = lambda kind, n: F.concat(F.lit(kind), (i % n).cast("string"))
    p = b.predictions(spark, sf_dir).withColumns(
        {
            "outlets": i % 6,
            "direct": i % 3,
            "buyer": F.when(i % 4 == 0, "").otherwise(named("Buyer ", 9)),
            "seller": F.when(i % 5 != 0, named("Seller ", 7)),
            "tier": F.element_at(F.array(*map(F.lit, ("thin", "developing", "broad_consensus"))), (i % 3 + 1).cast("int")),
        }
    )
    other = labels.counterparty(c("target_role"), c("buyer"), c("seller"))
    closest = F.when(i % 2 == 0, labels.comparison(c("club"), c("player"), c("actual_label"), F.lit(None).cast("double"))).otherwise("")
    value = F.when(i % 8 != 0, c("outlets") / 7.0)
    return p.select(
        "case_id",
        other.alias("counterparty"),
        labels.deal_path(c("buyer"), c("seller")).alias("path"),
        labels.signal_summary(c("tier"), c("target_role"), c("outlets"), c("direct"), other, closest).alias("summary"),
        labels.interpretation(F.when(i % 3 != 0, c("actual_label")).otherwise(""), c("predicted_label"), c("outlets")).alias("reading"),
        labels.number(value).alias("shown"),
        labels.percent(value).alias("share"),
    )


@query(
    "search_queries",
    f"""WITH n AS (SELECT n_nationkey AS k, replace(n_name, '_', ' ') AS name, CASE WHEN n_nationkey % 3 = 0 THEN [] ELSE ['Club ' || n_nationkey, 'Real Nation' || chr(97 + CAST(n_nationkey AS INTEGER)), replace(n_name, '_', ' ')] END AS al FROM nation),
    d AS (SELECT k, name, al, list_distinct(list_concat([name], al)) AS ds FROM n),
    o AS (SELECT k, name, al, list_filter(list_concat([name], al), lambda x: true) AS full_list FROM d),
    u AS (SELECT k, name, [name] || list_filter(al, lambda x: x <> name) AS u FROM o),
    f AS (SELECT k, name, u, list_filter(u, lambda x: length(replace(x, ' ', '')) >= 5 AND len(list_filter(string_split(x, ' '), lambda w: length(w) < 4)) = 0) AS long FROM u)
    SELECT o_orderkey AS article_id, '(' || coalesce(array_to_string(list_transform(long, lambda x: '"' || x || '"'), ' OR '), '') || ') (transfer OR signing OR signed OR agreement OR talks OR medical OR loan)' AS deals,
      '(' || array_to_string(list_transform(u, lambda x: '"' || x || '"'), ' OR ') || ') (transfer OR signing OR signed OR agreement OR talks OR medical OR bid OR bids OR loan)' AS club,
      CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '"Pat ' || c_custkey || '" ' END || '"' || name || '" (transfer OR signing OR signed OR agreement OR talks OR medical OR loan)' AS event
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN f ON f.k = c_nationkey""",
)
def search_queries(spark, sf_dir):
    """What would be searched for each order: the deals of its club, the club, and the event."""
    k = c("n_nationkey")
    name = F.replace("n_name", F.lit("_"), F.lit(" "))
    aliases = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Club "), k), F.concat(F.lit("Real Nation"), F.char(97 + k)), name))
    clubs = table(spark, sf_dir, "nation").select(k.alias("k"), name.alias("name"), labels.transfer_query(name, aliases).alias("deals"), labels.club_query(name, aliases).alias("club"))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey")).join(clubs, c("c_nationkey") == c("k"))
    player = F.when(c("o_orderkey") % 3 != 0, F.concat(F.lit("Pat "), c("c_custkey")))
    return rows.select(c("o_orderkey").alias("article_id"), "deals", "club", labels.event_query(c("name"), player).alias("event"))


@query(
    "text_labels",
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source, 'Outlet ' || (doc_id % 5) AS paper,
      CASE doc_id % 4 WHEN 0 THEN 'Google News' WHEN 1 THEN '' ELSE 'The Desk / Kim ' || (doc_id % 9) END AS feed,
      CASE WHEN doc_id % 3 = 0 THEN 'Story ' || doc_id || ' - Outlet ' || (doc_id % 5) ELSE 'Story ' || doc_id END AS title FROM documents),
    s AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN paper ELSE '' END AS suffix, CASE WHEN doc_id % 4 >= 2 THEN 'The Desk' ELSE feed END AS own,
      CASE WHEN doc_id % 6 = 0 THEN 'Font ' || (doc_id % 7) ELSE '' END AS font FROM d)
    SELECT doc_id, CASE WHEN own = 'Google News' THEN coalesce(nullif(suffix, ''), nullif(font, ''), own) ELSE coalesce(nullif(own, ''), nullif(suffix, ''), 'Unknown') END AS publisher,
      CASE WHEN doc_id % 4 >= 2 THEN 'Kim ' || (doc_id % 9) ELSE '' END AS reporter, coalesce(nullif(feed, ''), CASE WHEN doc_id % 2 = 0 THEN 'prov' END, 'www.site' || (doc_id % 6) || '.example') AS outlet,
      CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS n_items, 'surname' || (doc_id % 50) AS surname,
      round(CASE doc_id % 3 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.5e0 ELSE 0 END, 4) AS overlap, left(sha1('a' || '||' || doc_id || '||' || coalesce(source, '')), 16) AS id FROM s""",
)
def text_labels(spark, sf_dir):
    """Publishers behind feeds, reporters in bylines, outlets, listed items, surnames, shared words and stable ids."""
    i = c("doc_id")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    feed = F.when(i % 4 == 0, "Google News").when(i % 4 == 1, "").otherwise(say("The Desk / Kim ", i % 9))
    title = F.when(i % 3 == 0, say("Story ", i, " - Outlet ", i % 5)).otherwise(say("Story ", i))
    snippet = F.when(i % 6 == 0, say('<a href="x">y</a> <font color="#6f6f6f">Font ', i % 7, "</font>")).otherwise("plain")
    listed = F.when(i % 4 == 0, '["a", "b "]').when(i % 4 == 1, "a|b| c").when(i % 4 == 2, "a, b").otherwise("a b")
    url = say("https://WWW.site", i % 6, ".example/x?y=1")
    name, near = say("Ána Maria Surname", i % 50), F.when(i % 3 == 0, say("maria ÁNA surname", i % 50)).when(i % 3 == 1, say("Maria Surname", i % 50, " Costa")).otherwise("Bo Li")
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        text.publisher(feed, title, snippet).alias("publisher"),
        text.reporter(F.lit(None).cast("string"), feed).alias("reporter"),
        text.source_name(feed, F.when(i % 2 == 0, "prov"), url).alias("outlet"),
        F.size(text.parse_list(listed)).alias("n_items"),
        text.surname(name).alias("surname"),
        F.round(text.jaccard(name, near), 4).alias("overlap"),
        text.stable_id(F.lit("a"), i, c("source")).alias("id"),
    )


@query(
    "folded_names",
    """WITH n AS (SELECT c_custkey AS k, c_custkey % 8 AS f FROM customer)
    SELECT k, (['modric', 'gundogan', 'sesko', 'szczesny', 'odegaard', 'ibanez', 'final', 'joao felix'])[f + 1] || ' ' || k AS folded, (['modric', 'gundogan', 'sesko', 'szczesny', 'odegaard', 'ibanez', 'final', 'felix'])[f + 1] AS found
    FROM n""",
)
def folded_names(spark, sf_dir):
    """Names with accents of many kinds, folded, and found again in headlines that spell them without."""
    names = ("Modrić", "Gündoğan", "Šeško", "Szczęsny", "Ödegaard", "Ibáñez", "ﬁnal", "João Félix")
    k = c("c_custkey")
    name = F.element_at(F.array(*(F.lit(n) for n in names)), (k % 8 + 1).cast("int"))
    folded = text.alnum_folded(name)
    return table(spark, sf_dir, "customer").select(k.alias("k"), text.alnum_folded(F.concat(name, F.lit("́ "), k)).alias("folded"), F.element_at(F.split(folded, " "), -1).alias("found"))


@query(
    "season_labels",
    """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) - CAST(month(o_orderdate) < 7 AS INTEGER) AS INTEGER) AS y FROM orders),
    s AS (SELECT *, y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season, CAST(d - INTERVAL 9000 DAY AS DATE) AS born FROM o)
    SELECT k, CASE k % 5 WHEN 2 THEN '20' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') ELSE season END AS canonical, lpad(CAST(y % 100 AS VARCHAR), 2, '0') || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS code,
      y BETWEEN 1996 AND 1998 AS in_range, year(d) - year(born) - CAST(strftime(d, '%m%d') < strftime(born, '%m%d') AS INTEGER) AS age, k % 4 = 3 OR d BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AS in_window,
      CASE k % 4 WHEN 3 THEN 'soon' ELSE strftime(d, '%Y-%m-%d') END AS day, CASE WHEN k % 6 = 0 THEN 'earliest credible news/article date' WHEN k % 6 = 1 OR strftime(d, '%m-%d') IN ('07-01', '01-01') THEN 'proxy window date; not exact announcement date' WHEN k % 6 = 2 THEN 'source has transfer window timing' ELSE 'exact or source-provided date' END AS note FROM s""",
)
def season_labels(spark, sf_dir):
    """Season labels in five spellings, codes, ranges, ages, date windows, days as text, and what dates rest on."""
    k, d = c("k"), c("d")
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d")).withColumn("season", dates.season(d))
    y, born = dates.season_start(c("season")), F.date_sub(d, 9000)
    two = lambda n: F.lpad((n % 100).cast("string"), 2, "0")
    raw = F.when(k % 5 == 0, F.concat(y, F.lit("/"), two(y + 1))).when(k % 5 == 1, F.concat(y, F.lit("/"), y + 1)).when(k % 5 == 2, F.concat(two(y), F.lit("/"), two(y + 1))).when(k % 5 == 3, "whole year").otherwise(c("season"))
    written_day = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 4 == 1, F.concat(F.lit("Tue, "), F.date_format(d, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(k % 4 == 2, F.date_format(d, "yyyy-MM-dd")).otherwise("soon")
    source = F.when(k % 6 == 0, "first_credible_news").when(k % 6 == 1, "proxy_transfer_window")
    day = F.when(k % 4 != 3, F.to_timestamp(d))
    return o.select(
        "k",
        dates.canonical_season(raw, y.cast("string")).alias("canonical"),
        dates.league_code(c("season")).alias("code"),
        dates.season_in_range(c("season"), F.lit("1996-97"), F.lit("1998-99")).alias("in_range"),
        dates.age_on(born, d).alias("age"),
        dates.in_window(day, F.lit("1996-01-01").cast("timestamp"), F.lit("1997-12-31").cast("timestamp")).alias("in_window"),
        text.day_of(written_day).alias("day"),
        labels.date_note(source, d, k % 6 == 2).alias("note"),
    )


_PRIORS = {"outlet 1": 0.95, "outlet": 0.6, "desk": 0.3}
_WORDS = {"medical": 0.08, "loan": -0.05}


@query(
    "rumor_scores",
    f"""WITH {HEADLINES}, h AS (SELECT article_id, title, lower(title) AS t, CASE WHEN article_id % 4 = 0 THEN 'Outlet 12' WHEN article_id % 4 = 1 THEN 'The Outlet' WHEN article_id % 4 = 2 THEN 'Desk' ELSE 'Exclusive Wire' END AS source,
      CASE WHEN article_id % 7 = 0 THEN 'official' ELSE 'talks' END AS stage FROM headlines),
    p AS (SELECT *, CASE article_id % 4 WHEN 0 THEN 0.95e0 WHEN 1 THEN 0.6e0 ELSE 0.5e0 END AS prior,
      CASE WHEN contains(t, 'medical') THEN 0.08e0 ELSE 0 END - CASE WHEN contains(t, 'loan') THEN 0.05e0 ELSE 0 END AS delta FROM h),
    s AS (SELECT *, round(greatest(0, least(1, prior + delta)), 4) AS cred,
      CASE WHEN article_id % 4 = 3 THEN 'exclusive' WHEN contains(t, 'live') THEN 'live_blog' WHEN stage = 'official' THEN 'official' ELSE 'report' END AS kind FROM p),
    u AS (SELECT *, round(0.65e0 * cred + 0.35e0 * CASE WHEN regexp_matches(t, 'medical|agreement|signed') THEN 1.0e0 ELSE 0.4e0 END + 1e-9, 4) AS strength,
      CASE WHEN contains(t, 'agreement') THEN 0.10e0 ELSE 0 END + CASE WHEN contains(t, 'medical') THEN 0.10e0 ELSE 0 END + CASE WHEN contains(t, 'confirm') THEN 0.08e0 ELSE 0 END + CASE WHEN contains(t, 'talks') THEN 0.04e0 ELSE 0 END + CASE WHEN contains(t, 'interested') THEN 0.02e0 ELSE 0 END AS told FROM s)
    SELECT article_id, prior, cred, kind, strength, round(greatest(0, least(1, 0.45e0 * cred + 0.35e0 * strength + 0.20e0 * least(1, (article_id % 6) / 4) + told)) + 1e-9, 4) AS indicator,
      round(greatest(-0.08, least(0.08, (strength - 0.5) * 0.05 + ((article_id % 10) / 10 - 0.5) * 0.06 * CASE WHEN article_id % 2 = 0 THEN 1 ELSE 0.65 END)) + 1e-9, 4) AS expected_car,
      round(greatest(0, least(1, 0.35e0 + 0.45e0 * strength)) + 1e-9, 4) AS belief, regexp_matches(t, '(^|[^a-z])(transfer|sign|talks|agreement|bid|deal|agreed|medical|join|sell|loan|exit)([^a-z]|$)') AND NOT contains(t, 'match report') AS is_story FROM u""",
)
def rumor_scores(spark, sf_dir):
    """Credibility, kind, strength and indicator of headlines, the impact they let expect, and whether they are about a deal."""
    i = c("article_id")
    source = F.when(i % 4 == 0, "Outlet 12").when(i % 4 == 1, "The Outlet").when(i % 4 == 2, "Desk").otherwise("Exclusive Wire")
    h = b.headlines(spark, sf_dir).withColumns({"source": source, "stage": F.when(i % 7 == 0, "official").otherwise("talks")})
    h = h.withColumns({"prior": scoring.source_prior(c("source"), _PRIORS), "cred": F.round(scoring.text_credibility(c("title"), c("source"), _PRIORS, _WORDS), 4)})
    h = h.withColumn("strength", scoring.rounded(scoring.rumor_strength(c("title"), c("cred"))))
    car, belief = scoring.expected_impact(c("strength"), (i % 10) / 10.0, F.when(i % 2 == 0, "in").otherwise("out"))
    return h.select(
        "article_id",
        "prior",
        "cred",
        scoring.article_kind(c("title"), c("source"), c("stage")).alias("kind"),
        "strength",
        scoring.rounded(scoring.rumor_indicator(c("cred"), c("strength"), (i % 6).cast("double"), c("title"))).alias("indicator"),
        scoring.rounded(car).alias("expected_car"),
        scoring.rounded(belief).alias("belief"),
        text.is_transfer_story(c("title")).alias("is_story"),
    )


@query(
    "money_fields",
    f"""WITH {TRANSFERS} SELECT deal_id, line, player_id, CASE WHEN line % 4 = 0 THEN NULL ELSE round(round(transfer_fee_eur / 1000000, 3) * 1000000, 2) END AS fee_eur, round(CASE WHEN market_value_eur > 0 THEN ln(1 + market_value_eur) ELSE 0 END, 6) AS log_value,
      round(market_value_eur - transfer_fee_eur, 2) AS room, coalesce(CASE WHEN line % 3 = 0 THEN NULL ELSE line * 1.5e0 END, -1) AS number, line % 5 IN (0, 1, 2) AS flag,
      round(greatest(0, least(1, line / 1.2e0)) * CASE WHEN is_loan THEN 0.85e0 ELSE 1 END + 1e-9, 4) AS match, round(greatest(0, least(1, 0.40e0 * 0.5e0 + 0.20e0 * (line / 7.0e0) + 0.20e0 * 0.4e0 + 0.10e0 * age / 50 + 0.10e0 * 0.5e0)) + 1e-9, 4) AS indicator,
      CASE line % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' ELSE CASE WHEN line > 5 THEN 'positive' WHEN line < 5 THEN 'negative' ELSE 'neutral' END END AS mood,
      round(greatest(0, least(1, 0.30e0 + 0.45e0 * abs(age - 28) / 100 + 0.25e0 * line / 7)) + 1e-9, 4) AS confidence FROM transfers""",
)
def money_fields(spark, sf_dir):
    """Fees in millions as text, logarithms, room to the market value, numbers and flags as text, and scores made of them."""
    n, none = c("line"), F.lit(None).cast("double")
    raw = F.when(n % 4 == 0, F.when(n % 8 == 0, "NA").otherwise("")).otherwise(F.format_string("%.3f", c("transfer_fee_eur") / 1_000_000))
    odd = F.when(n % 3 == 0, "n/a").otherwise((n * 1.5).cast("string"))
    flag = F.element_at(F.array(*map(F.lit, ("1", "true", "Yes", "0", ""))), (n % 5 + 1).cast("int"))
    result = F.element_at(F.array(*map(F.lit, ("Win", "l", "draw", "?"))), (n % 4 + 1).cast("int"))
    return b.transfers(spark, sf_dir).select(
        "deal_id",
        "line",
        "player_id",
        F.round(scoring.money_from_millions(raw), 2).alias("fee_eur"),
        F.round(scoring.log_money(c("market_value_eur")), 6).alias("log_value"),
        F.round(scoring.market_minus_fee(c("transfer_fee_eur"), c("market_value_eur")), 2).alias("room"),
        scoring.parse_number(odd, -1.0).alias("number"),
        scoring.parse_flag(flag).alias("flag"),
        scoring.rounded(scoring.entity_match(n.cast("double"), c("is_loan"))).alias("match"),
        scoring.rounded(scoring.component_indicator(none, n / 7.0, none, c("age") / 50, none)).alias("indicator"),
        scoring.result_sentiment(result, n, F.lit(5)).alias("mood"),
        scoring.rounded(scoring.blended_confidence(c("age") - 28, n / 7.0)).alias("confidence"),
    )
