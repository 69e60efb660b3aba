"""Evidence of findings in the code itself: known defences near a sink, entries of input, line marks in comments, tiers of review, and controls without a bearing on the query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import hash_order
from .scan import RULES

# fixed values: defences by type of finding, entries of input, definitions, languages that have defences, and thresholds of tiers
RUNS_A_SHELL = [
    r"\b(?:sh|bash|zsh|dash|ksh|ash|cmd|powershell|pwsh)\s*[\"']?\s*,",
    r"--(?:upload|receive)-pack",
    r"[-\-](?:exec|execdir|ok|okdir)\b",
    r"\b(?:python\d*|perl|ruby|node|php|lua|rscript)\s*[\"']?\s*,\s*[\"']?-['\"cer]",
]
DEFENCES = {
    "Command Injection": r"shlex\.quote|subprocess\.(?:run|Popen|call|check_output|check_call)\(\s*\[(?![^\]]*(?:" + "|".join(RUNS_A_SHELL) + r"))|shell\s*=\s*False",
    "SQL Injection": r"\?\s*,\s*\(|%(?:s|d)\s*,\s*\(|execute\(\s*['\"][^'\"]*['\"]\s*,\s*\(|prepareStatement\(|setString\(|setInt\(|setLong\(",
    "XSS": r"html\.escape|markupsafe|(?<!un)(?<!re\.)escape\(",
    "Path Traversal": r"\.startswith\(|startswith\(",
    "Server-Side Template Injection": r"autoescape\s*=\s*(?:True|select_autoescape)",
    "Insecure Deserialization": r"json\.loads|yaml\.safe_load",
}
ENTRY = (
    r"request\.|\.GET\b|\.POST\b|\.args\b|\.form\b|\.cookies\b|\.query\b|\.body\b|"
    r"\binput\(|sys\.argv|os\.environ|os\.getenv|"
    r"json\.load|yaml\.load|\.read\(\)|\.readlines\(\)|recv\(|socket\.|"
    r"\$_(GET|POST|REQUEST|COOKIE|SERVER)\b|php://input"
)
DEFINITION = r"\b(?:def|function|class)\s+\w+|=>\s*\{|public\s+(?:static\s+)?[\w<>\[\],\s]+\s+\w+\s*\("
VERIFIABLE = ["python", "py", "javascript", "js", "typescript", "ts"]
HIGH_RISK, HIGH_SPOTS = 12.0, 2


def evidence_gate(code, language, kind, sink_line, confirmed) -> Column:
    """sink_defended where the four lines before a confirmed finding's sink, the sink or the three lines behind hold a defence against its kind; no_input_entry for a script
    without input and definitions; else null. Kinds without known defences and other languages pass, and so does empty code. A hit asks for review, it doesn't clear."""
    t, kind_, at = F.coalesce(T.col(code), F.lit("")), T.col(kind), F.coalesce(T.col(sink_line), F.lit(0))
    ls = F.split(t, "\r?\n")
    lo, hi = F.greatest(at - 4, F.lit(1)), F.least(at + 3, F.size(ls))
    near = F.when((at > 0) & (hi >= lo), F.array_join(F.slice(ls, lo, hi - lo + 1), "\n")).otherwise("")
    defended = F.lit(False)
    for k, pattern in DEFENCES.items():
        defended = defended | ((kind_ == k) & near.rlike(pattern))
    asked = F.coalesce(T.col(confirmed), F.lit(False)) & (t != "") & F.lower(T.col(language)).isin(VERIFIABLE) & kind_.isin(list(DEFENCES))
    return F.when(asked & defended, "sink_defended").when(asked & ~t.rlike(ENTRY) & ~t.rlike(DEFINITION), "no_input_entry")


def line_marks(code) -> Column:
    """array<struct<declared, actual>>: comments of a code block that name their line, the first of each line."""
    marked = F.transform(F.split(F.coalesce(T.col(code), F.lit("")), "\n"), lambda x, i: F.struct(F.regexp_extract(x, r"(?i)(?:#|//|--|/\*|<!--)\s*line\s*([0-9]+)", 1).alias("n"), (i + 1).alias("actual")))
    return F.transform(F.filter(marked, lambda m: m["n"] != ""), lambda m: F.struct(m["n"].try_cast("bigint").alias("declared"), m["actual"]))


def review_tier(risk, n_spots, n_high, key, sampling: float = 0.1, samples: int = 3, seed: str = "tier", high_risk: float = HIGH_RISK, high_spots: int = HIGH_SPOTS) -> Column:
    """struct<tier, reason, votes> of a file without candidates. C isn't covered (no verdict, not a safe one); a share of it, by a hash of the key, moves to B. Nulls count as 0."""
    risk, spots, high = (F.coalesce(T.col(x), F.lit(0)) for x in (risk, n_spots, n_high))
    drawn = F.conv(F.left(hash_order(T.col(key), seed), F.lit(8)), 16, 10).cast("double") / float(1 << 32) < sampling
    why = (
        F.when((spots > 0) & ((risk >= high_risk) | (high >= high_spots)), "high_risk_or_high_spots").when(spots > 0, "low_risk_with_spots").when(risk >= high_risk, "zero_spot_but_high_risk")
        .when(drawn, "c_tier_sampled").otherwise("zero_spot_low_risk")
    )
    tier = F.when(why == "high_risk_or_high_spots", "A").when(why == "zero_spot_low_risk", "C").otherwise("B")
    votes = F.when(tier == "A", max(1, min(3, samples))).when(tier == "B", 1).otherwise(0)
    return F.struct(tier.alias("tier"), why.alias("reason"), votes.alias("votes"))


def rule_classes(spark: SparkSession) -> DataFrame:
    """(rule, cwe, severity): the table of rules, for joins."""
    return spark.createDataFrame([(r.name, r.cwe, r.severity) for r in RULES], "rule string, cwe string, severity string")


def with_class(findings: DataFrame, rule: str = "rule") -> DataFrame:
    """findings with the class of their rule, null for one that isn't in the table. The table is as long as the module's list, so it is broadcast."""
    classes = rule_classes(findings.sparkSession).select(F.col("rule").alias("__rule"), "cwe")
    return findings.join(F.broadcast(classes), F.col(rule) == F.col("__rule"), "left").drop("__rule")


def random_context(base: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """k rows of the base in hash order, whatever the query: a top-k of each partition and of those."""
    return base.orderBy(hash_order(F.col(key), seed), key).limit(k)


def padded(block: str, length) -> Column:
    """A block of text, one copy a line, cut at so many characters: as long as the context that it stands for."""
    n = F.coalesce(T.col(length), F.lit(0))
    copies = F.ceil(n / float(len(block) + 1)).cast("int") + 1
    return F.left(F.repeat(F.lit(block + "\n"), copies), n)


def without_private(df: DataFrame) -> DataFrame:
    """df without columns whose names begin with an underscore."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])


def save_thresholds(thresholds: DataFrame, path: str, alpha: float) -> bool:
    """Writes the one row of thresholds, unless one of them is null, and says whether it did."""
    whole = thresholds.where("q_vuln IS NOT NULL AND q_safe IS NOT NULL").withColumn("alpha", F.lit(alpha))
    if whole.isEmpty():
        return False
    whole.coalesce(1).write.mode("overwrite").json(path)
    return True


def load_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """The row that save_thresholds wrote."""
    return spark.read.schema("q_vuln double, q_safe double, alpha double").json(path)
