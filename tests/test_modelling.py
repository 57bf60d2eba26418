"""The model data path and imports on small tables."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import imports as im
from tidemark.operators import learning, modelling


@pytest.fixture(scope="module")
def rows(spark):
    """`x` tells the labels apart, `noise` and `kind` do not; every ninth row is of no scope, every seventh has no x."""
    labels = learning.LABELS
    data = [
        (i, dt.date(2020, 1, 1) + dt.timedelta(days=i), 2019 + i // 100, labels[i % 3], "none" if i % 9 == 0 else "direct", "ok", None if i % 7 == 0 else float(i % 3), float(i * 37 % 11), ["a", "b", None, " "][i % 4], 1.0)
        for i in range(240)
    ]
    schema = "id bigint, day date, season_start int, label string, prediction_scope string, market_feature_status string, x double, noise double, kind string, abnormal_return_0_p3 double"
    return spark.createDataFrame(data, schema)


def test_leaky_columns_stay_out(rows):
    assert modelling.active(rows, ["x", "abnormal_return_0_p3", "gone", "label"]) == ["x"]


def test_usable(rows):
    odd = rows.limit(1).withColumns({"label": F.lit("?"), "prediction_scope": F.lit("direct")}).unionByName(rows.limit(1).withColumns({"market_feature_status": F.lit("missing_bars"), "prediction_scope": F.lit("direct")}))
    assert modelling.usable(rows.unionByName(odd)).count() == rows.where("prediction_scope = 'direct'").count()


def test_choice_and_gate(rows):
    common = {"featuresCol": "scaled", "labelCol": "_y", "weightCol": "_w"}
    candidates = {"logistic": LogisticRegression(family="multinomial", maxIter=10, **common), "stump": RandomForestClassifier(numTrees=1, maxDepth=1, seed=1, **common)}
    presets = {"full": ["x", "noise"], "noise": ["noise"]}
    usable = modelling.usable(rows)
    best, figures = modelling.chosen(usable, presets, ["kind"], candidates, ["day", "id"], 2100)
    assert best == ("full", "logistic") and figures[best] > figures["noise", "logistic"] and len(figures) == 4
    model = modelling.fitted(usable, presets["full"], ["kind"], candidates["logistic"])
    got = modelling.predicted(model, rows.withColumn("kind", F.lit("unseen")), presets["full"], ["kind"], 2020).collect()
    assert len(got) == 240
    for r in got:
        if r.prediction_scope == "none":
            assert r.split == "intelligence_only" and r.predicted_label is None and r.prob_neutral is None
        else:
            assert r.split == ("train" if r.season_start <= 2020 else "test")
            assert abs(r.prob_negative + r.prob_neutral + r.prob_positive - 1) < 1e-6
            assert r.predicted_label == r.label or r.x is None
    names = modelling.feature_names(model, presets["full"], ["kind"])
    assert names == ["x", "x__missing", "noise", "noise__missing", "kind=a", "kind=b", "kind=unknown", "kind=__unseen"]
    assert modelling.importance(["b", "a", "c"], [-2.0, 2.0, 1.0], 2) == [("a", 2.0), ("b", -2.0)]


def test_majority(spark, rows):
    train = spark.createDataFrame([("neutral",), ("neutral",), ("positive",)], "label string")
    got = modelling.majority(train, rows.limit(3)).collect()
    assert {(r.predicted_label, round(r.prob_neutral, 4), r.prob_negative) for r in got} == {("neutral", 0.6667, 0.0)}


def test_folding(spark):
    names = ["Modrić", "Gündoğan", "Šeško", "Szczęsny", "Őry", "Ødegaard", "ﬁnal ½", "João", "Lukasz Łoś", "Ｆｕｌｌ", None]
    want = ["modric", "gundogan", "sesko", "szczesny", "ory", "degaard", "final", "joao", "lukasz os", "full", ""]
    got = spark.createDataFrame(list(enumerate(names)), "i int, n string").select("i", text.alnum_folded(F.col("n")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == want


def test_club_ids(spark):
    clubs = spark.createDataFrame([(1, "FC Ajax Amsterdam", "ajax-amsterdam"), (2, "PSV", None), (3, "Other", "other"), (4, None, None)], "club_id int, name string, club_code string")
    names = spark.createDataFrame([("Ajax", "Ajax"), ("PSV Eindhoven", "PSV"), ("zz", "ZZ")], "alias string, canonical string")
    assert {(r.club_id, r.club) for r in im.club_ids(clubs, names).collect()} == {(1, "Ajax"), (2, "PSV")}


def test_unknown_movement_ends_the_job(spark):
    row = ("Ajax", "2020/21", "2020", "P", "20", "x", "B", "1", "1", "sideways", "Summer")
    rows = spark.createDataFrame([row], "club_name string, season string, year string, player_name string, age string, position string, club_involved_name string, fee string, fee_cleaned string, transfer_movement string, transfer_period string")
    names = spark.createDataFrame([("ajax",)], "alias string")
    with pytest.raises(PySparkException, match="unknown movement"):
        im.window_transfers(rows, names, "2019-20", "2021-22").collect()
    with pytest.raises(ValueError, match="loan policy"):
        im.by_loan_policy(rows, "some")


def test_window_rows_stay_where_they_lie(spark):
    """Few names are broadcast, not merged by club, and a filter on seasons makes a season once."""
    from tidemark.functions import dates

    columns = "club_name string, season string, year string, player_name string, age string, position string, club_involved_name string, fee string, fee_cleaned string, transfer_movement string, transfer_period string"
    rows = spark.createDataFrame([(f" Club {i % 3} ", s, "2020", "Pat", "21", "x", "Other", "1m", "1.5", "in", "Summer") for i, s in enumerate(["2019/20", "19-20", "unknown", None, "2023/24", "2018-19"])], columns)
    names = spark.createDataFrame([("CLUB 0",), ("club 1",)], "alias string")
    t = im.window_transfers(rows, names, "2019-20", "2021-22")
    assert sorted((r.club, r.season) for r in t.collect()) == [("Club 0", "2019-20"), ("Club 0", "2020-21"), ("Club 1", "2019-20")]
    assert "SortMergeJoin" not in t._jdf.queryExecution().executedPlan().toString()
    s = spark.range(30).select((F.col("id") * 700).cast("string").alias("y"), F.concat("id", F.lit("/"), F.col("id") + 1).alias("l"))
    made = s.select(dates.canonical_season(F.col("l"), F.col("y")).alias("s"), dates.season_in_range(dates.canonical_season(F.col("l"), F.col("y")), F.lit("2010-11"), F.lit("2012-13")).alias("in"))
    assert {r.s for r in made.collect() if r["in"]} == {"2010-11", "2011-12", "2012-13"}
    assert made.where("in")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 6


def test_candidates_share_the_rows_they_learn_from(spark):
    """Rows are ordered and read from their source once, however many candidates and presets there are; a model that is made of
    shared features is the one that is fitted alone."""
    from pyspark.ml.classification import LogisticRegression

    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def number(i):
        read.add(1)
        return float(i % 7)

    i = F.col("id")
    label = F.element_at(F.array(*map(F.lit, ("negative", "neutral", "positive"))), (i % 7 % 3 + 1).cast("int"))
    rows = spark.range(200).select(i, label.alias("label"), number(i).alias("x"), (i % 5).cast("double").alias("z"), F.concat(F.lit("c"), i % 4).alias("club"), F.date_add(F.lit("2020-01-01").cast("date"), (i % 50).cast("int")).alias("day"), F.lit("direct").alias("prediction_scope"), F.lit(2020).alias("season_start"))
    make = lambda reg: LogisticRegression(family="multinomial", maxIter=5, regParam=reg, featuresCol="scaled", labelCol="_y", weightCol="_w")
    best, figures = modelling.chosen(rows, {"full": ["x", "z"], "core": ["x"]}, ["club"], {"a": make(0.01), "b": make(10.0)}, ["day", "id"], 2021)
    assert set(figures) == {(p, n) for p in ("full", "core") for n in "ab"} and best in figures
    assert read.value <= 400
    model = modelling.fitted(rows, ["x"], ["club"], make(0.01))
    assert modelling.feature_names(model, ["x"], ["club"]) == ["x", "x__missing", "club=c0", "club=c1", "club=c2", "club=c3", "club=__unseen"]
    assert modelling.predicted(model, rows, ["x"], ["club"], 2021).where("predicted_label is not null and prob_neutral > 0").count() == 200
