"""Domain tables made from the given ones: price bars, events, transfers, claims, articles, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

LEAST_EVENT_PRICE = 450_000


def stock_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per market segment and day: mean order price and number of orders."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"), F.count(F.lit(1)).alias("volume"))


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per day over all orders."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"), F.count(F.lit(1)).alias("volume"))


def market_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large urgent orders: event_id, ticker, event_date."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    big = orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") >= LEAST_EVENT_PRICE))
    return big.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("event_id"), F.col("c_mktsegment").alias("ticker"), F.to_date("o_orderdate").alias("event_date"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as moves of a player (customer) from the customer's nation to the supplier's."""
    l, o, c, s, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "part"))
    # Orders meet customers first, so that line items aren't shuffled by customer.
    known = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = l.join(known, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_orderkey").alias("deal_id"),
        F.col("l_linenumber").alias("line"),
        F.to_date("l_shipdate").alias("date"),
        F.col("o_custkey").alias("player_id"),
        F.col("c_name").alias("player"),
        F.col("c_nationkey").alias("from_id"),
        F.col("s_nationkey").alias("to_id"),
        F.when(F.col("l_returnflag") == "R", "out").otherwise("in").alias("direction"),
        (F.lit(18) + F.col("p_size") % 20).cast("double").alias("age"),
        (F.col("p_retailprice") * F.col("l_quantity")).alias("market_value_eur"),
        F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")).otherwise(0.0).alias("transfer_fee_eur"),
        (F.col("l_tax") * 100_000_000).alias("wage_eur_annual"),
        (F.col("l_returnflag") == "A").alias("is_loan"),
        F.col("p_brand").alias("position"),
    )


STAGES = {"view": "linked", "click": "talks", "signup": "agreed", "purchase": "official", "error": "unclear"}


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims: reporter = user, stage by type, club = props.k mod 25, player = user x props.k mod 40."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    stage = F.element_at(F.create_map(*(F.lit(x) for kv in STAGES.items() for x in kv)), F.col("event_type"))
    return e.select(
        F.col("event_id").alias("claim_id"),
        F.col("ts").alias("published_at"),
        F.concat(F.lit("reporter "), F.col("user_id")).alias("journalist"),
        F.concat(F.lit("outlet "), F.col("user_id") % 12).alias("source"),
        F.concat(F.lit("NATION_"), k % 25).alias("club"),
        F.concat(F.lit("player "), k % 40).alias("player"),
        stage.alias("rumor_stage"),
        F.when(F.col("event_type").isin("view", "click"), "in").when(F.col("event_type") == "purchase", "out").otherwise("unclear").alias("direction"),
        F.col("value").alias("fee"),
        F.when(F.col("event_id") % 3 == 0, "none").otherwise("direct").alias("prediction_scope"),
        F.concat(F.lit("Headline "), k % 7, F.lit(" for player "), k % 40, F.lit(" - outlet "), F.col("user_id") % 12).alias("title"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the first line is the title."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("article_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.coalesce("text", F.lit("")).alias("body"),
        "source",
        "lang",
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("published_at"),
    )


#: Phrases of the headlines that are made from orders, by o_orderkey mod 12.
PHRASES = (
    "close on deal to sign",
    "in talks with",
    "interested in transfer of",
    "confirm agreement to sign",
    "bid for",
    "medical booked for",
    "loan with option for",
    "sell",
    "match report about",
    "set to join from",
    "monitoring the exit of",
    "deal agreed for",
)


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as headlines about a customer and a nation, with a fee."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("o_orderkey") % len(PHRASES) + 1).cast("int"))
    club, player = F.replace("n_name", F.lit("_"), F.lit(" ")), F.concat(F.lit("Pat Surname"), F.col("c_custkey"))
    euros = F.floor(F.col("o_totalprice") / 10_000).cast("string")
    snippet = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Fee of €"), euros, F.lit("m, wage £"), euros, F.lit("k a week."))).otherwise(F.concat(F.lit("Worth $"), euros, F.lit(".5m.")))
    return rows.select(F.col("o_orderkey").alias("article_id"), F.concat(club, F.lit(" "), phrase, F.lit(" "), player).alias("title"), snippet.alias("snippet"), club.alias("club"), player.alias("player"), F.to_date("o_orderdate").alias("date"))


LABELS = ("negative", "neutral", "positive")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scored cases, with probabilities and fields that follow from the id and the length."""
    d = table(spark, sf_dir, "documents")
    i, n = F.col("doc_id"), F.col("n_chars")
    pos, neg = (i * 37 % 100) / 250.0 + 0.1, (n % 100) / 250.0 + 0.1
    rows = d.select(
        i.alias("case_id"),
        F.element_at(F.array(*map(F.lit, LABELS)), (i % 3 + 1).cast("int")).alias("actual_label"),
        pos.alias("prob_positive"),
        neg.alias("prob_negative"),
        (1 - pos - neg).alias("prob_neutral"),
        F.element_at(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))), (i % 5 + 1).cast("int")).alias("club"),
        F.concat(F.lit("player "), i % 60).alias("player"),
        F.date_add(F.lit("1996-01-01").cast("date"), (i * 13 % 1800).cast("int")).alias("signal_date"),
        F.concat((F.lit(1995) + i * 13 % 1800 / 365).cast("int"), F.lit("-x")).alias("season"),
        F.when(i % 4 == 0, "test").when(i % 4 == 1, "live").otherwise("train").alias("split"),
        F.element_at(F.array(*map(F.lit, ("in", "out", "unclear"))), (n % 3 + 1).cast("int")).alias("direction"),
        F.element_at(F.array(*map(F.lit, ("linked", "talks", "bid", "advanced", "agreed", "medical", "official"))), (i % 7 + 1).cast("int")).alias("rumor_stage"),
        F.when(n % 2 == 0, "buyer").otherwise("seller").alias("target_role"),
        ((n % 101) / 100.0).alias("credibility_score"),
        ((i % 89) / 88.0).alias("transfer_indicator"),
        ((i % 11) / 10.0).alias("rumor_stage_score"),
        ((n % 13) / 12.0).alias("stock_context_indicator"),
        ((n % 17) / 16.0).alias("journalist_rep"),
        ((i % 19) / 18.0).alias("conversion"),
        (18.0 + i % 20).alias("age"),
        ((n % 500) * 200_000.0).alias("market_value_eur"),
        "source",
    )
    top = F.greatest("prob_negative", "prob_neutral", "prob_positive")
    label = F.when(F.col("prob_negative") == top, "negative").when(F.col("prob_neutral") == top, "neutral").otherwise("positive")
    return rows.withColumns({"predicted_label": label, "prediction_confidence": top})
