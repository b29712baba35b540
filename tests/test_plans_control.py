from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions.expressions import ExpressionError, parse
from millrace.operators import clean as c
from millrace.operators import control as k
from millrace.operators import criteria as q
from millrace.operators import validate as v
from millrace.plans import pipeline as p


def test_a_run_splits_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, " Ann ", 5.0), (2, None, 3.0), (3, "bob", -1.0)], "id long, name string, x double")
    spec = p.PipelineSpec("t", [p.clean_stage(c.CleanConfig(case="lower")), p.validate_stage([v.Rule("name", "required", severity="critical"), v.Rule("x", "range", {"min": 0}, severity="warning")], "id")])
    got = p.run(spec, df, f"{tmp_path}/good", f"{tmp_path}/bad")
    assert (got.read, got.accepted, got.rejected, got.warned, got.status) == (3, 2, 1, 1, "PARTIAL")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/good").collect()} == {(1, "ann", 5.0), (3, "bob", -1.0)}
    assert spark.read.csv(f"{tmp_path}/bad", header=True).first().rejection_reason == "name: required"


def test_a_run_with_too_many_failures_loads_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "id long, name string")
    spec = p.PipelineSpec("t", [p.validate_stage([v.Rule("name", "required", severity="critical")], "id")], most_failed=0.4)
    assert p.run(spec, df, f"{tmp_path}/good", f"{tmp_path}/bad").rejected == 1
    assert not (tmp_path / "good").exists()


def test_specs_are_checked(spark):
    df = spark.range(1)
    same = p.Stage("s", lambda d: d)
    with pytest.raises(ValueError, match="2 times"):
        p.folded(p.PipelineSpec("t", [same, same]), df)
    with pytest.raises(ValueError, match="no stages"):
        p.folded(p.PipelineSpec("t", []), df)
    with pytest.raises(ValueError, match="lacks name"):
        p.folded(p.PipelineSpec("t", [p.Stage("s", lambda d: d, ["name"])]), df)
    assert p.folded(p.PipelineSpec("t", [p.Stage("s", lambda d: d.limit(0), ["name"], optional=True)]), df).count() == 1



def test_dependencies(spark):
    runs = spark.createDataFrame([(1, 1, "SUCCESS", datetime(2024, 1, 1), 0), (2, 2, "FAILED", datetime(2024, 1, 1), 5), (2, 3, "RUNNING", datetime(2024, 1, 2), 0)], "job_id long, execution_id long, status string, start_time timestamp, records_successful long")
    deps = spark.createDataFrame([(1, 10, "SUCCESS", True), (1, 11, "DATA_AVAILABILITY", True), (2, 12, "COMPLETION", True), (2, 13, "COMPLETION", False), (9, 14, "SUCCESS", True), (1, 14, "SUCCESS", True)], "parent_job_id long, child_job_id long, dependency_type string, is_active boolean")
    jobs = spark.createDataFrame([(j,) for j in range(10, 15)], "job_id long")
    assert sorted(r.job_id for r in k.executable_jobs(jobs, deps, runs).collect()) == [10, 13]
    assert [r.job_id for r in k.triggered(runs.where("status = 'SUCCESS'").select("job_id"), deps, runs).collect()] == [10]


def test_criteria(spark):
    df = spark.createDataFrame([(1, "Ab%"), (2, "abc"), (3, None)], "n int, s string")
    find = lambda tree: sorted(r.n for r in q.listed(df, tree).collect())
    assert find({}) == [1, 2, 3] and find([]) == [1, 2, 3]
    assert find([["s", "like", "B%"]]) == [1]
    assert find({"or": [["n", "=", "1"], {"and": [["s", "is_null"]]}]}) == [1, 3]
    assert find({"or": []}) == []
    assert find({"n": 2, "or": [["n", ">", 1]]}) == [2]
    with pytest.raises(ValueError, match="no column"):
        find([["x", "=", 1]])
    with pytest.raises(ValueError, match="no operator"):
        find([["n", "~", 1]])


def test_pages(spark):
    df = spark.range(1, 8).toDF("n")
    assert [r.n for r in q.page(df, [("n", "desc")], 2, 3).collect()] == [4, 3, 2]
    assert tuple(q.page_info(df, 3, 3).first()) == (7, 3, False, True)
    first = q.after_cursor(df, "n", None, 4).collect()
    assert [r.n for r in first] == [1, 2, 3, 4] and first[0].has_more
    assert [(r.n, r.has_more) for r in q.after_cursor(df, "n", 4, 4).collect()] == [(5, False), (6, False), (7, False)]


def test_expressions_are_never_run_as_code(spark):
    df = spark.createDataFrame([(4, 0, "x")], "a int, b int, c string")
    assert df.select(parse("$a / $b").alias("x")).first().x is None
    assert df.select(parse("len($c) == 1 and $a in [1, 4]").alias("x")).first().x is True
    for bad in ("__import__('os')", "$a.real", "[x for x in $a]", "lambda: 1", "open('f')", "a + 1"):
        with pytest.raises(ExpressionError):
            parse(bad)


def test_summaries_of_nothing(spark):
    cols = "job_id long, execution_id long, status string, start_time timestamp, end_time timestamp, records_processed long, records_failed long"
    none = spark.createDataFrame([], cols)
    now = datetime(2024, 1, 1)
    assert k.dashboard(none, now, "30d").first().success_rate == 0
    assert k.job_health(none, now).first().status == "healthy"
    assert k.horizons(none, now).where("runs > 0").count() == 0
    assert k.daily_trend(none).count() == 0
    assert k.error_summary(spark.createDataFrame([], "severity string, is_resolved boolean")).agg(F.sum("errors")).first()[0] == 0
