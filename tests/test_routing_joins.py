"""Questions are not gathered by a word that most of them have."""

from __future__ import annotations

from tidemark.operators import routing


def test_names_come_to_the_questions(spark):
    questions = spark.createDataFrame([(i, f"Latest on Pat Surname{i % 3}") for i in range(30)], "q int, question string")
    names = spark.createDataFrame([(f"Pat Surname{i}",) for i in range(3)], "name string")
    found = routing.best_name(questions, names)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.q: r.name for r in found.collect()} == {i: f"Pat Surname{i % 3}" for i in range(30)}
