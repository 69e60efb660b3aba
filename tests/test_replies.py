import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quillmill.functions import labels as L
from quillmill.functions import replies as R
from quillmill.operators import leaks as K
from quillmill.operators import metrics as M
from quillmill.plans.replies import GOLDEN


def by_character(text):
    out, start, depth, quoted, skip = [], -1, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='{}"\\a\n ', max_size=40))
def test_objects_equal_a_scan_by_character(text):
    assert R.objects_in(text) == by_character(text)


def test_triage_ladder():
    assert R.triage(None) is None and R.triage("no verdict") is None
    assert R.triage('{"is_confirmed": true, "reason": " r "}')["is_confirmed"] == "true"
    fenced = 'see {"is_confirmed": false} ```json\n{"has_vulnerability": true, "explanation": "a } b"}\n```'
    assert R.triage(fenced) == {"is_confirmed": "true", "reason": "a } b", "vulnerability_type": "", "fix_suggestion": "", "source": "", "sink": "", "explanation": "a } b"}
    assert R.triage('example {a: 1} then {"has_vulnerability": false}')["is_confirmed"] == "false"
    assert R.triage('cut off {"is_confirmed": TRUE, "reason": "x')["is_confirmed"] == "true"


def test_columns(spark):
    rows = spark.createDataFrame([(None,), ("",), ('x {"is_confirmed": false} {',)], "t string")
    got = rows.select(R.json_objects("t").alias("o"), R.triage_verdict("t").alias("v")).collect()
    assert [r.o for r in got] == [[], [], ['{"is_confirmed": false}']] and [r.v.is_confirmed for r in got] == [None, None, "false"]


def test_golden_labels(spark):
    more = [("SQL Injection", "CWE-89 SQL Injection"), ("codei", "CWE-94 Code Injection"), ("logi", "CWE-117 Improper Output Neutralization for Logs"), ("CWE-89 Log Injection", "CWE-117 Improper Output Neutralization for Logs"), (None, "none"), ("None", "none")]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(GOLDEN + more)], "i int, raw string")
    got = {r.i: r.label for r in df.select("i", L.class_label("raw").alias("label")).collect()}
    assert [got[i] for i in range(len(got))] == [w for _, w in GOLDEN + more]


def test_both_ends(spark):
    items = spark.createDataFrame([(1, "abcdefghij klmnop"), (2, "short")], "item_id long, text string")
    parts = spark.createDataFrame([(1, "abcdef XX lmnop"), (2, "abcdeX lmnop"), (3, "abc"), (4, None), (5, "abcdeXXbcdef")], "doc_id long, line string")
    assert [(r.doc_id, r.item_id) for r in K.both_ends(parts, items, "line", "text", "item_id", 5).orderBy("doc_id").collect()] == [(1, 1), (2, 1), (5, 1)]


def test_bootstrap_equals_single_draws(spark):
    df = spark.createDataFrame([("a", i % 4 == 0) for i in range(80)] + [("b", None)], "g string, h boolean")
    got = {r.g: r for r in M.bootstrap_rates(df, ["g"], F.col("h")).collect()}
    rng = np.random.default_rng(1)
    draws = np.sort((rng.random((4000, 80)) < 0.25).mean(1))
    assert got["a"].mean == 0.25 and abs(got["a"].low - draws[100]) <= 0.0251 and abs(got["a"].high - draws[3900]) <= 0.0251
    assert got["b"].n == 0 and (got["b"].mean is None or np.isnan(got["b"].mean))


def test_hard_samples_overlap(spark):
    df = spark.createDataFrame([(1, True, False, ["A"], [], 20.0), (2, True, True, ["A"], ["B"], 1.0), (3, False, None, [], [], None)], "doc_id long, expected boolean, predicted boolean, expected_cwes array<string>, model_cwes array<string>, elapsed double")
    assert sorted((r.doc_id, r.kind) for r in M.hard_samples(df, 10.0).collect()) == [(1, "fn"), (1, "slow"), (2, "class_mismatch")]


VERDICTS = [
    (None, None), ("", None), ("no json", None),
    ('x ```json\n{"has_vulnerability": true, "sink": "a } b"}\n``` y', ("fence", "true", "a } b")),
    ('```json\n{"has_vulnerability": true}\n``` then ```json\n{"has_vulnerability": false}\n```', ("fence", "false", None)),
    ('```json\n{"has_vulnerability": true}\n``` then ```\n{"other": 1}\n```', ("fence", "true", None)),
    ('says {"note": 1} and {"has_vulnerability": null, "sink": "s"} end', ("text", None, "s")),
    ('{"outer": {"has_vulnerability": "maybe", "sink": "in"}}', ("text", "maybe", "in")),
    ('{ open, then {"has_vulnerability": 1}', ("text", "1", None)),
    ('{"has_vulnerability": true, "sink": "line 3", "line 4", "risk_level": "High"}', ("text", "true", "line 3 line 4")),
    ('{"has_vulnerability": true, "sink": "<a class="x">", "risk_level": "High"}', ("fields", "true", '<a class="x">')),
    ("- **has_vulnerability**: false\n- **sink**: none\n", ("fields", "false", "none")),
    ("has_vulnerability: perhaps", None),
]


def test_tiers_of_a_verdict(spark):
    rows = [(i, r) for i, (r, _) in enumerate(VERDICTS)]
    got = {r.i: (r.v.tier, r.v.has_vulnerability, r.v.sink) if r.v.tier else None for r in spark.createDataFrame(rows, "i int, r string").select("i", R.verdict_of("r").alias("v")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(VERDICTS)}
