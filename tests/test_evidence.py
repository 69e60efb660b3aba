import pytest
from pyspark.sql import functions as F

from quillmill.operators import evidence as E


def one(spark, column, rows, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_evidence_gate(spark):
    far = "html.escape(x)\n" + "pass\n" * 4 + "show(input())"
    cases = [
        ((far, "python", "XSS", 6, True), None), ((far, "Py", "XSS", 5, True), "sink_defended"), ((far, "php", "XSS", 5, True), None), ((far, "py", "XSS", 5, False), None), ((far, "py", "Logic", 5, True), None),
        (("a = 1\nrun(a)", "py", "SQL Injection", 2, True), "no_input_entry"), (("def f(a):\n run(a)", "py", "SQL Injection", 2, True), None), (("a = 1\nrun(a)", "py", "SQL Injection", None, True), "no_input_entry"), (("", "py", "XSS", 1, True), None), ((None, None, None, None, None), None),
        (("x = input()\nsubprocess.run(['ls', x])", "py", "Command Injection", 2, True), "sink_defended"), (("x = input()\nsubprocess.run(['sh', '-c', x])", "py", "Command Injection", 2, True), None), (("x = input()\nhtml.unescape(x)", "js", "XSS", 2, True), None), (("x = input()", "py", "XSS", 99, True), None),
    ]
    assert one(spark, E.evidence_gate("code", "lang", "kind", "at", "ok"), [r for r, _ in cases], "code string, lang string, kind string, at int, ok boolean") == [w for _, w in cases]


def test_line_marks(spark):
    got = one(spark, E.line_marks("t"), [("a # line 1\n// Line 5 line 6\n<!--line2",), (None,), ("outline 3",), ("-- line 99999999999999999999",)], "t string")
    assert [[tuple(m) for m in g] for g in got] == [[(1, 1), (5, 2), (2, 3)], [], [], [(None, 1)]]


def test_tiers(spark):
    rows = [(12.0, 1, 0, 1), (0.0, 5, 2, 1), (11.9, 1, 1, 1), (12.0, 0, 0, 1), (None, None, None, 1)]
    got = [tuple(r) for r in one(spark, E.review_tier("r", "s", "h", "k", sampling=0.0), rows, "r double, s int, h int, k long")]
    assert got == [("A", "high_risk_or_high_spots", 3), ("A", "high_risk_or_high_spots", 3), ("B", "low_risk_with_spots", 1), ("B", "zero_spot_but_high_risk", 1), ("C", "zero_spot_low_risk", 0)]
    drawn = spark.range(4000).select(E.review_tier(F.lit(0), F.lit(0), F.lit(0), "id").alias("v")).where("v.reason = 'c_tier_sampled' AND v.tier = 'B'").count()
    assert 320 < drawn < 480


def test_controls_and_columns(spark):
    assert one(spark, E.padded("abc", "n"), [(0,), (3,), (4,), (9,), (None,)], "n int") == ["", "abc", "abc\n", "abc\nabc\na", ""]
    base = spark.range(50)
    first = [r.id for r in E.random_context(base, "id", 5, "s").collect()]
    assert len(set(first)) == 5 and first == [r.id for r in E.random_context(base.repartition(7), "id", 5, "s").collect()] != [r.id for r in E.random_context(base, "id", 5, "t").collect()]
    assert E.without_private(spark.createDataFrame([(1, 2, 3)], "a int, _b int, `c.d` int")).columns == ["a", "c.d"]
    assert sorted((r.rule, r.cwe) for r in E.with_class(spark.createDataFrame([("os_command",), ("other",), (None,)], "rule string")).collect() if r.rule) == [("os_command", "CWE-78"), ("other", None)]


def test_thresholds_come_back(spark, tmp_path):
    whole = spark.createDataFrame([(0.25, 0.5)], "q_vuln double, q_safe double")
    assert E.save_thresholds(whole, str(tmp_path / "t"), 0.1) and tuple(E.load_thresholds(spark, str(tmp_path / "t")).first()) == (0.25, 0.5, pytest.approx(0.1))
    assert not E.save_thresholds(spark.createDataFrame([(0.25, None)], whole.schema), str(tmp_path / "u"), 0.1)
