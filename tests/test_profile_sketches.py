import shutil

from millrace.operators import profile as p


def test_merged_profiles(spark):
    df = spark.range(200_000).selectExpr("id % 4 AS part", "concat('v', id % 150000) AS many", "cast(id % 7 AS string) AS few", "CASE WHEN id % 10 = 0 THEN NULL ELSE 'x' END AS gaps")
    columns = ["many", "few", "gaps"]
    exact = {r.column_name: r for r in p.profile(df, columns).collect()}
    for got in (p.merged_profile(p.summaries(df, columns, by="part")), p.merged_profile(p.summaries(df, columns)), p.profile(df, columns, exact=[])):
        for r in got.collect():
            want = exact[r.column_name].asDict()
            assert abs(r.unique_count - want["unique_count"]) <= 0.025 * want["unique_count"]
            rest = {k: v for k, v in r.asDict().items() if k not in ("unique_count", "uniqueness_ratio")}
            assert rest == {k: want[k] for k in rest}
    assert exact["many"].unique_count == 150_000
    some = {r.column_name: r.unique_count for r in p.profile(df, columns, exact=["many"]).collect()}
    assert some == {"many": 150_000, "few": 7, "gaps": 1}
    assert {r.total_count for r in p.profile(df.limit(0), columns, exact=["few"]).collect()} == {0}


def test_files_are_read_once(spark, tmp_path):
    files = [f"{tmp_path}/f{i}" for i in range(3)]
    for i, f in enumerate(files):
        spark.range(i * 100, i * 100 + 150).selectExpr("cast(id AS string) AS v", "1 AS w").write.parquet(f)
    kept = f"{tmp_path}/kept"
    first = {r.column_name: r for r in p.profile_of_files(spark, files[:2], kept, ["v", "w"]).collect()}
    assert (first["v"].total_count, first["v"].unique_count, first["w"].unique_count) == (300, 250, 1)
    for f in files[:2]:
        shutil.rmtree(f)  # what is known is not read again
    both = {r.column_name: r for r in p.profile_of_files(spark, files, kept, ["v", "w"]).collect()}
    assert (both["v"].total_count, both["v"].unique_count) == (450, 350)
    last = {r.column_name: r for r in p.profile_of_files(spark, files[2:], kept, ["v", "w"]).collect()}
    assert (last["v"].total_count, last["v"].unique_count) == (150, 150)
