"""Gates whose order is part of the result: the first reason that holds, repaired fields, tags, rewards and routes.

Verdicts are JSON texts. Null or broken JSON has no field, so it fails as `missing_fields`; an expectation that is null fails as `direction`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .gates import RISK_LEVELS, VAGUE, issues

# fixed values: marks, fields, spellings and weights of the gates
MONOLOGUE = r"\b(Actually|Hmm+|Let me|Wait,|sorry|I'll|I've|Okay,|Ah,)\b"
META = ["安全模式白名单", "命中安全模式"]
CONTRACT = ["has_vulnerability", "vulnerability_type", "risk_level", "source", "sink", "explanation", "fix_suggestion"]
SECTIONS = ["has_vulnerability", "vulnerability_type", "risk_level", "cvss_vector", "cvss_score", "source", "sink", "explanation", "fix_suggestion"]
NO_RISK = ["n/a", "na", "无", "不适用"]
CVSS = r"(?i)^CVSS:3\.1/AV:[NALP]/AC:[LH]/PR:[NLH]/UI:[NR]/S:[UC]/C:[HLN]/I:[HLN]/A:[HLN]$"
SAYS_SAFE = "未发现漏洞|不存在漏洞|代码是安全的|没有漏洞|安全代码"
SAYS_VULNERABLE = "存在漏洞|存在安全漏洞|这里存在"
NOT_GIVEN = ["", "n/a", "none", "无", "null"]
W_FORMAT, W_VERDICT, PEN_FN, PEN_FP, W_CLASS, W_EVIDENCE, W_LENGTH, FORMAT_FLOOR, SHORT = 0.1, 0.5, -0.3, -0.5, 0.2, 0.1, 0.1, 0.05, 300
MOST_CHARS, MOST_STEPS = 6000, 5


def first_reason(*tests: tuple[str, Column]) -> Column:
    """The name of the first test that holds, null if none does."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in tests])


def _sized(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def style_reason(reply) -> Column:
    """Why a reply's style is refused: too_long, english, monologue, meta_leak, no_steps, vague_steps. A null reply is an empty one."""
    t = F.coalesce(T.col(reply), F.lit(""))
    words, meta = _sized(t, "[A-Za-z]{2,}"), F.lit(False)
    for m in META:
        meta = meta | F.contains(t, F.lit(m))
    steps = F.filter(F.split(T.analysis_body(t), "\n"), lambda x: x.rlike(r"^\s*[0-9]+\."))
    said = F.transform(steps, lambda x: F.regexp_extract(x, r"^\s*[0-9]+\.\s*[^：:]{2,20}[：:]\s*(.*)$", 1))
    vague = F.size(F.filter(said, lambda x: F.trim(x).rlike(VAGUE)))
    return first_reason(("too_long", F.length(t) > MOST_CHARS), ("english", (words > 60) & (words > 3 * F.greatest(T.cjk(t), F.lit(1)))), ("monologue", t.rlike("(?U)" + MONOLOGUE)), ("meta_leak", meta), ("no_steps", F.size(steps) == 0), ("vague_steps", vague >= 2))


class _Fields:
    """Fields of a JSON object: their kinds and texts."""

    def __init__(self, obj) -> None:
        self.json = F.try_parse_json(T.col(obj))

    def kind(self, name: str) -> Column:
        """BOOLEAN, STRING, BIGINT, DECIMAL(..), VOID, ...; null if the field is missing."""
        return F.schema_of_variant(F.try_variant_get(self.json, f"$.{name}", "variant"))

    def text(self, name: str) -> Column:
        return F.coalesce(F.try_variant_get(self.json, f"$.{name}", "string"), F.lit(""))

    def missing(self, names: list[str]) -> Column:
        absent = F.lit(False)
        for n in names:
            absent = absent | self.kind(n).isNull()
        return absent

    def says(self) -> Column:
        return F.try_variant_get(self.json, "$.has_vulnerability", "boolean")

    def wrong_way(self, expected: Column) -> Column:
        return ~self.says().eqNullSafe(expected)


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, F.lit(2), F.length(text))))


def contract(obj, expected, code) -> Column:
    """struct<reason, risk_level, vulnerability_type>: the verdict's fields checked against what is expected and the numbered code (`n| ...`), with repairs.

    A safe verdict's risk of `N/A` becomes None and its descriptive type `none`; a mixed type becomes its first class number. Safe verdicts
    aren't asked for line numbers; others may cite lines up to two behind the code.
    """
    f, expect = _Fields(obj), T.col(expected)
    raw, type_ = f.text("risk_level"), f.text("vulnerability_type")
    no_risk = ~_capital(raw).isin(RISK_LEVELS) & F.lower(F.trim(raw)).isin(NO_RISK) & ~expect
    number = F.regexp_extract(type_, "(CWE-[0-9]+)", 1)
    mixed = ~type_.rlike("^CWE-[0-9]+") | type_.rlike(r"CWE-[0-9]+\s*/\s*(?:CWE-)?[0-9]+") | type_.rlike(r"^CWE-[0-9]+\s*[:：]")
    none = F.lower(F.trim(type_)).isin("none", "")
    fixed = F.when(~expect, F.when(none | type_.rlike("(?i)CWE-[0-9]+"), type_).otherwise("none")).otherwise(F.when(mixed & (number != ""), number).otherwise(type_))
    last = F.array_max(F.transform(F.regexp_extract_all(F.coalesce(T.col(code), F.lit("")), F.lit(r"(?m)^\s*([0-9]+)\|"), 1), lambda x: x.cast("double")))
    others = F.map_filter(F.from_json(T.col(obj), "map<string, string>"), lambda k, v: k != "vulnerability_type")
    cited = F.transform(F.regexp_extract_all(F.concat_ws(" ", F.to_json(others), fixed), F.lit(r"(?i)line\s*([0-9]+)"), 1), lambda x: x.cast("double"))
    outside = (last > 0) & F.exists(cited, lambda n: (n < 1) | (n > last + 2))
    reason = first_reason(
        ("missing_fields", f.missing(CONTRACT)), ("not_boolean", f.kind("has_vulnerability") != "BOOLEAN"), ("direction", f.wrong_way(expect)), ("bad_risk", ~_capital(raw).isin(RISK_LEVELS) & ~no_risk),
        ("safe_with_class", ~expect & ~none & type_.rlike("(?i)CWE-[0-9]+")), ("no_class", expect & (number == "")), ("line_out_of_range", expect & outside),
    )
    return F.struct(reason.alias("reason"), F.when(no_risk, "None").otherwise(raw).alias("risk_level"), fixed.alias("vulnerability_type"))


def sections(obj, reasoning, expected) -> Column:
    """struct<reason, risk_level, n_steps, anchored>: the check of a verdict and the numbered steps before it; anchored (a step cites a line) is told but doesn't refuse."""
    f, expect = _Fields(obj), T.col(expected)
    risk = _capital(F.trim(f.text("risk_level")))
    steps = F.regexp_extract_all(F.coalesce(T.col(reasoning), F.lit("")), F.lit(r"(?:^|\n)\s*[0-9]+[.)]\s*([^\n]+)"), 1)
    score = F.try_variant_get(f.json, "$.cvss_score", "double")
    numeric = f.kind("cvss_score").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    reason = first_reason(
        ("missing_fields", f.missing(SECTIONS)), ("not_boolean", f.kind("has_vulnerability") != "BOOLEAN"), ("direction", f.wrong_way(expect)), ("bad_risk", (f.kind("risk_level") != "STRING") | ~risk.isin(RISK_LEVELS)),
        ("bad_vector", expect & ~f.text("cvss_vector").rlike(CVSS)), ("bad_score", expect & ~(numeric & score.between(0, 10))), ("no_steps", F.size(steps) == 0), ("too_many_steps", F.size(steps) > MOST_STEPS),
        ("safe_with_class", ~expect & ~f.text("vulnerability_type").isin("none", "None", "N/A", "")),
    )
    anchored = F.exists(steps, lambda x: x.rlike(r"(?i)第\s*[0-9]+\s*行|line\s*[0-9]+"))
    return F.struct(reason.alias("reason"), risk.alias("risk_level"), F.size(steps).alias("n_steps"), anchored.alias("anchored"))


def output_tags(raw, says, outcome, expected_present, predicted, model_class, expected_classes) -> Column:
    """Names of what is wrong with an output. says is its parsed verdict, expected_classes an array (empty or null: any class is right)."""
    t, says, cls, want = F.coalesce(T.col(raw), F.lit("")), T.col(says), T.col(model_class), T.col(expected_classes)
    body = F.lower(T.analysis_body(t))
    third = F.floor(F.length(t) / 3).cast("int")
    piece = F.substring(t, third + 1, F.lit(80))
    again = F.length(t) - F.length(F.replace(t, piece, F.lit(""))) > F.length(piece)
    return issues(
        ("cwe_mismatch", (T.col(outcome) == "TP") & (F.size(want) > 0) & ~F.coalesce(F.array_contains(want, cls), F.lit(False))), ("missing_verdict", says.isNull()), ("too_short", F.length(t) < 200), ("too_long", F.length(t) > 4000),
        ("no_json_block", ~F.contains(t, F.lit("```json")) & ~F.contains(t, F.lit('"has_vulnerability"'))), ("cot_json_inconsistent", (says & body.rlike(SAYS_SAFE)) | (~says & body.rlike(SAYS_VULNERABLE))), ("repetition", (F.length(t) > 500) & again),
        ("fp_with_cwe", ~T.col(expected_present) & T.col(predicted) & (F.coalesce(cls, F.lit("")) != "")),
    )


def grounded(says, sink, code) -> Column:
    """Whether a positive verdict's sink names something that stands in the code; line marks don't count."""
    t, c = F.coalesce(T.col(sink), F.lit("")), F.coalesce(T.col(code), F.lit(""))
    names = F.regexp_extract_all(F.regexp_replace(t, r"line\s*[0-9]+\s*[:：]", " "), F.lit("([A-Za-z_][A-Za-z0-9_.]{2,})"), 1)
    named = F.filter(names, lambda x: ~F.lower(x).isin("line", "nan", "none"))
    return F.coalesce(T.col(says), F.lit(False)) & ~F.lower(F.trim(t)).isin(NOT_GIVEN) & F.exists(named, lambda x: F.contains(c, x))


def reward(output, says, model_class, sink, expected_present, expected_class, code) -> Column:
    """struct<format, verdict, class, evidence, length, total, outcome>: classes, evidence and length count for right verdicts only."""
    t, says, expected = F.coalesce(T.col(output), F.lit("")), T.col(says), F.coalesce(T.col(expected_present), F.lit(False))
    zero = F.lit(0.0)
    outcome = F.when(says.isNull(), "parse_fail").when(says & expected, "TP").when(~says & ~expected, "TN").when(expected, "FN").otherwise("FP")
    right, hit = outcome.isin("TP", "TN"), outcome == "TP"
    number = lambda c: F.regexp_extract(F.coalesce(T.col(c), F.lit("")), "(?i)CWE-?([0-9]+)", 1)
    before = F.instr(t, "```json")
    thought = F.when(before > 1, F.left(t, before - 1)).otherwise(t)
    parts = {
        "format": F.when(~says.isNull(), W_FORMAT).when(F.contains(t, F.lit("```json")), FORMAT_FLOOR).otherwise(zero),
        "verdict": F.when(right, W_VERDICT).when(outcome == "FN", PEN_FN).when(outcome == "FP", PEN_FP).otherwise(zero),
        "class": F.when(hit & (number(model_class) != "") & (number(model_class) == number(expected_class)), W_CLASS).otherwise(zero),
        "evidence": F.when(hit & grounded(says, sink, code), W_EVIDENCE).otherwise(zero),
        "length": F.when(right & (F.floor(F.length(thought) / 3) <= SHORT), W_LENGTH).otherwise(zero),
    }
    total = F.round(sum(parts.values(), zero), 4)
    return F.struct(*[v.alias(k) for k, v in parts.items()], total.alias("total"), outcome.alias("outcome"))


def route(category, owned, secret_like, strong) -> Column:
    """struct<category, kept, reason> of an alert. Strong secrets are reported as they are, weak ones are judged like other alerts; alerts by position of an unknown type that aren't about secrets go."""
    c, owned, like, strong = T.col(category), *[F.coalesce(T.col(x), F.lit(False)) for x in (owned, secret_like, strong)]
    stray = c.isin("sast", "iac") & ~owned
    to = F.when((c == "secret") & ~strong, "sast").when(stray & like & strong, "secret").otherwise(c)
    why = F.when((c == "secret") & strong, "direct").when(c == "secret", "weak_secret").when(stray & like & strong, "strong_secret").when(stray & like, "judged").when(stray, "ownerless").otherwise("owned")
    return F.struct(to.alias("category"), (why != "ownerless").alias("kept"), why.alias("reason"))


def priority(rejected, ready, confidence) -> Column:
    """Priority of a candidate: 0.6 where its rule was rejected in the same file, 1 + confidence where the rule is ready, else 1; it orders and never removes."""
    return F.when(F.coalesce(T.col(rejected), F.lit(False)), 0.6).when(F.coalesce(T.col(ready), F.lit(False)), F.lit(1.0) + F.coalesce(T.col(confidence), F.lit(0.0))).otherwise(1.0)
