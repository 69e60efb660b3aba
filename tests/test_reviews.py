import json

from pyspark.sql import functions as F

from quillmill.operators import reviews as V

GOOD = {"has_vulnerability": True, "vulnerability_type": "CWE-89", "risk_level": "High", "source": "a", "sink": "line 2: run", "explanation": "x", "fix_suggestion": "bind"}
SCORED = GOOD | {"cvss_vector": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "cvss_score": 9.8}
SAFE = {"has_vulnerability": False, "vulnerability_type": "none", "risk_level": "None"}


def one(spark, column, rows, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_style(spark):
    cases = [
        ("1. 查：有\n```json", None), (None, "no_steps"), ("", "no_steps"), ("x" * 6001, "too_long"), ("ab " * 61, "english"), ("ab " * 61 + "中" * 21 + "\n1. 查：有", None), ("1. Let me see", "monologue"), ("1. 命中安全模式", "meta_leak"),
        ("1. 来源：N/A\n2. 结论: 无", "vague_steps"), ("1. 来源：N/A\n2. 结论: 有", None), ("```json\n1. x", "no_steps"), ("1. Wait, x", None), ("1. Wait,x", "monologue"),
    ]
    assert one(spark, V.style_reason("t"), [(t,) for t, _ in cases], "t string") == [w for _, w in cases]


def test_contract(spark):
    code = "1| a\n2| b"
    cases = [
        (GOOD, True, (None, "High", "CWE-89")), ({k: v for k, v in GOOD.items() if k != "sink"}, True, ("missing_fields",)), (GOOD | {"has_vulnerability": "true"}, True, ("not_boolean",)), (GOOD, False, ("direction",)), (GOOD, None, ("direction",)),
        (GOOD | {"risk_level": "hIGH"}, True, (None, "hIGH", "CWE-89")), (GOOD | {"risk_level": "N/A"}, True, ("bad_risk",)), (GOOD | SAFE | {"risk_level": " n/a"}, False, (None, "None", "none")), (GOOD | SAFE | {"vulnerability_type": "已防御"}, False, (None, "None", "none")),
        (GOOD | SAFE | {"vulnerability_type": "no cwe-89"}, False, ("safe_with_class",)), (GOOD | {"vulnerability_type": "root（CWE-250）"}, True, (None, "High", "CWE-250")), (GOOD | {"vulnerability_type": "CWE-79/80"}, True, (None, "High", "CWE-79")),
        (GOOD | {"vulnerability_type": "CWE-79: XSS"}, True, (None, "High", "CWE-79")), (GOOD | {"vulnerability_type": "XSS"}, True, ("no_class",)), (GOOD | {"sink": "line 4"}, True, (None, "High", "CWE-89")), (GOOD | {"sink": "Line 5"}, True, ("line_out_of_range",)),
        (GOOD | {"sink": "line 0"}, True, ("line_out_of_range",)), (GOOD | SAFE | {"sink": "line 99"}, False, (None, "None", "none")), (GOOD | {"source": None}, True, (None, "High", "CWE-89")), (None, True, ("missing_fields",)), ("{", True, ("missing_fields",)),
    ]
    rows = [(o if o is None or isinstance(o, str) else json.dumps(o, ensure_ascii=False), e, code) for o, e, _ in cases]
    for got, (o, _, want) in zip(one(spark, V.contract("o", "e", "c"), rows, "o string, e boolean, c string"), cases, strict=True):
        assert tuple(got)[: len(want)] == want, o


def test_sections(spark):
    cases = [
        (SCORED, "1. 第 3 行\n2) b", True, (None, "High", 2, True)), (SCORED | {"risk_level": " high "}, "1. b", True, (None, "High", 1, False)), (SCORED | {"risk_level": 3}, "1. b", True, ("bad_risk",)), (GOOD, "1. b", True, ("missing_fields",)),
        (SCORED | {"cvss_vector": "N/A"}, "1. b", True, ("bad_vector",)), (SCORED | {"cvss_score": "9"}, "1. b", True, ("bad_score",)), (SCORED | {"cvss_score": 10.1}, "1. b", True, ("bad_score",)), (SCORED | {"cvss_score": 10}, "1. b", True, (None,)),
        (SCORED, "b", True, ("no_steps",)), (SCORED, None, True, ("no_steps",)), (SCORED, "\n".join(f"{i}. b" for i in range(6)), True, ("too_many_steps",)), (SCORED | SAFE | {"cvss_vector": "N/A"}, "1. b", False, (None, "None", 1, False)),
        (SCORED | SAFE | {"vulnerability_type": "x"}, "1. b", False, ("safe_with_class",)),
    ]
    got = one(spark, V.sections("o", "r", "e"), [(json.dumps(o), r, e) for o, r, e, _ in cases], "o string, r string, e boolean")
    for g, (o, *_, want) in zip(got, cases, strict=True):
        assert tuple(g)[: len(want)] == want, o


def test_tags(spark):
    body = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(200))
    cases = [
        (("", None, "parse_fail", True, None, None, None), ["missing_verdict", "too_short", "no_json_block"]), ((body, True, "TP", True, True, "CWE-1", ["CWE-2"]), ["cwe_mismatch", "no_json_block"]), ((body, True, "TP", True, True, None, ["CWE-2"]), ["cwe_mismatch", "no_json_block"]),
        ((body + "```json", True, "TP", True, True, "CWE-2", ["CWE-2"]), []), (("未发现漏洞" + body + "```json", True, "TP", True, True, "CWE-2", []), ["cot_json_inconsistent"]), (("ab" * 300 + "```json", False, "TN", False, False, None, None), ["repetition"]),
        ((body + "```json 存在漏洞", False, "TN", False, False, None, None), []), ((body + "```json", True, "FP", False, True, "CWE-2", None), ["fp_with_cwe"]), (("```json" + "".join(map(str, range(1500))), True, "TN", False, False, "", None), ["too_long"]),
    ]
    got = one(spark, V.output_tags("raw", "says", "outcome", "ep", "p", "cls", "want"), [r for r, _ in cases], "raw string, says boolean, outcome string, ep boolean, p boolean, cls string, want array<string>")
    assert got == [w for _, w in cases]


def test_reward(spark):
    cases = [
        (("x```json", True, "CWE-89 a", "line 3: run(", True, "cwe89", "run(x)"), ("TP", 1.0)), (("x", True, None, "line 3: line", True, None, "line"), ("TP", 0.7)), (("x" * 903 + "```json", False, "", "", False, "", ""), ("TN", 0.6)), (("x", False, "", "", True, "", ""), ("FN", -0.2)),
        (("x", True, "CWE-1", "run", False, "CWE-1", "run"), ("FP", -0.4)), (("a ```json", None, "", "", True, "", ""), ("parse_fail", 0.05)), ((None, None, None, None, None, None, None), ("parse_fail", 0.0)),
    ]
    got = one(spark, V.reward("o", "says", "m", "s", "e", "c", "code"), [r for r, _ in cases], "o string, says boolean, m string, s string, e boolean, c string, code string")
    assert [(g.outcome, g.total) for g in got] == [w for _, w in cases]


def test_routes_and_priorities(spark):
    cases = [
        (("secret", False, True, True), ("secret", True, "direct")), (("secret", False, True, False), ("sast", True, "weak_secret")), (("sast", True, False, False), ("sast", True, "owned")), (("iac", False, True, True), ("secret", True, "strong_secret")),
        (("sast", False, True, False), ("sast", True, "judged")), (("iac", None, None, None), ("iac", False, "ownerless")), (("taint", False, False, False), ("taint", True, "owned")),
    ]
    assert [tuple(x) for x in one(spark, V.route("c", "o", "l", "s"), [r for r, _ in cases], "c string, o boolean, l boolean, s boolean")] == [w for _, w in cases]
    got = one(spark, F.round(V.priority("r", "y", "c"), 6), [(True, True, 0.5), (False, True, 0.5), (None, None, None)], "r boolean, y boolean, c double")
    assert got == [0.6, 1.5, 1.0]
