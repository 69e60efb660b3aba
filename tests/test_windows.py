from datetime import datetime, timedelta

from quillmill.sources import windows as W

SCHEMA = "id int, at timestamp_ntz, v string"
START = datetime(2024, 3, 1, 5)


def rows(many=500):
    return [(i, START + timedelta(minutes=37 * i), f"v{i % 7}") for i in range(many)] + [(9999, None, "none"), (3, START, "again")]


def test_resumes_without_loss_or_repeats(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    path = str(tmp_path / "a")
    assert W.taken(df, path).count() == 0
    total = len(W.spans(df, "at", timedelta(days=1)))
    assert W.take_over(df, "at", timedelta(days=1), path, page=2, most=3) == total - 3
    first = {(r.id, r.v) for r in W.taken(df, path).collect()}
    assert first == {(i, v) for i, t, v in rows() if t and t < datetime(2024, 3, 4)}
    # a run that broke off after writing a window and before noting it
    df.where("at >= '2024-03-04' AND at < '2024-03-04 10:00:00'").selectExpr("*", "'20240304T000000' AS window").write.mode("append").partitionBy("window").parquet(f"{path}/data")
    assert {(r.id, r.v) for r in W.taken(df, path).collect()} == first
    assert W.take_over(df, "at", timedelta(days=1), path, page=4) == 0
    assert W.take_over(df, "at", timedelta(days=1), path) == 0
    got = sorted((r.id, r.at, r.v) for r in W.taken(df, path).collect())
    assert got == sorted(r for r in rows() if r[1])


def test_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert W.take_over(none, "at", timedelta(days=1), str(tmp_path / "b")) == 0 and W.taken(none, str(tmp_path / "b")).count() == 0
