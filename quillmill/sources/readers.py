"""Readers and writers of the formats that corpora come in. All go through Spark's own sources, so any file system will do."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.checkpoints import shared_folder

CORRUPT = "_corrupt_record"

# fixed values: languages by file extension
EXTENSIONS = {"py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "java": "java", "go": "go", "php": "php", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "rs": "rust", "sh": "shell", "sql": "sql", "html": "html", "vue": "vue"}
#: Path parts that a repository scan leaves out.
EXCLUDED = r"/(node_modules|\.git|dist|build|vendor|__pycache__|\.venv|target)/"


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, keep_bad: bool = False) -> DataFrame:
    """Rows of a JSON lines file. Bad lines are left out, or kept with their text in _corrupt_record; every row has a content key."""
    known = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    full = StructType([*known.fields, StructField(CORRUPT, StringType())])
    # the lines are parsed from text rather than by the json source, which refuses queries of the corrupt column alone
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    rows = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    out = rows.select("r.*", F.sha2("value", 256).alias("row_key"))
    return out if keep_bad else out.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_weighted_jsonl(spark: SparkSession, path: str, schema: str, source: str, weight: float, most: int | None = None) -> DataFrame:
    """Rows of a source with its name and weight, up to `most` of them in the order of their keys."""
    rows = read_jsonl(spark, path, schema).withColumns({"source": F.lit(source), "weight": F.lit(weight)})
    return rows.orderBy("row_key").limit(most) if most is not None else rows


def read_manifest(spark: SparkSession, path: str, field: str = "samples") -> DataFrame:
    """One row per element of an array in JSON documents."""
    return spark.read.json(path, multiLine=True).select(F.explode(field).alias("x")).select("x.*")


def flatten_runs(results: DataFrame, key: str = "file") -> DataFrame:
    """(run_seed, columns of a record): the records of repeated runs, or of the single one where all_runs is absent or null."""
    single = F.array(F.col("samples"))
    runs = F.coalesce(F.col("all_runs"), single) if "all_runs" in results.columns else single
    return results.select(F.posexplode(runs).alias("run_seed", "run")).select("run_seed", F.explode("run").alias("x")).select("run_seed", "x.*")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, language, code) of whole text files below a folder, without excluded folders."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("code"))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    language = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]
    return files.where(~F.col("path").rlike(EXCLUDED)).select("path", F.coalesce(language, F.lit("text")).alias("language"), "code")


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def latest_file(spark: SparkSession, path: str, pattern: str = "*") -> str | None:
    """The path of the newest file, by time and then by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    row = files.agg(F.max(F.struct("modificationTime", "path")).alias("m")).first()
    return row["m"]["path"] if row and row["m"] else None


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those done: a job started again goes on where it stopped."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; a failed write leaves nothing behind but the commit protocol's temporary folder."""
    df.write.mode(mode).json(path)


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result per finding (rule, severity, path, line, message), as JSON with a stable fingerprint."""
    print_ = F.sha2(F.concat_ws("|", "rule", "path", F.col("line").cast("string")), 256)
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    where = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), where.alias("locations"), F.struct(print_.alias("primary")).alias("partialFingerprints"))
    return findings.select(print_.alias("fingerprint"), F.to_json(result).alias("result"))


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A report of a small result (`most` rows at most) as a Markdown table."""
    rows = df.limit(most).collect()
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def tool_findings(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """(tool, rule, severity, message, path, line) from a scanner's JSON report; tools: bandit, semgrep, gitleaks."""
    from ..functions.verdicts import normalize_severity

    shapes = {
        "bandit": ("results", "array<struct<test_id: string, issue_severity: string, issue_text: string, filename: string, line_number: int>>", ("test_id", "issue_severity", "issue_text", "filename", "line_number")),
        "semgrep": ("results", "array<struct<check_id: string, path: string, start: struct<line: int>, extra: struct<severity: string, message: string>>>", ("check_id", "extra.severity", "extra.message", "path", "start.line")),
        "gitleaks": (None, "array<struct<RuleID: string, Severity: string, Description: string, File: string, StartLine: int>>", ("RuleID", "Severity", "Description", "File", "StartLine")),
    }
    field, kind, (rule, severity, message, file, line) = shapes[tool]
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", kind if field is None else f"struct<{field}: {kind}>").alias("j"))
    x = parsed.select(F.explode("j" if field is None else f"j.{field}").alias("x"))
    c = lambda name: F.col(f"x.{name}")
    return x.select(F.lit(tool).alias("tool"), c(rule).alias("rule"), normalize_severity(c(severity)).alias("severity"), c(message).alias("message"), c(file).alias("path"), c(line).alias("line"))


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def paged_windows(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """(lo, hi): date windows of so many days that cover a span, as a paged download asks for them."""
    one = spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval {days} days)")).alias("lo"))
    return one.select("lo", F.least(F.date_add("lo", days), F.lit(end).cast("date")).alias("hi")).where("lo < hi")


def source_caps(df: DataFrame, source: str, order: list, caps: dict[str, int]) -> DataFrame:
    """Up to caps[source] rows of each source in an order; sources without a cap stay whole."""
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col(source)]
    w = Window.partitionBy(source).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(cap.isNull() | (F.col("__rn") <= cap)).drop("__rn")
