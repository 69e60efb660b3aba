"""Column functions on verdicts, severities, credentials and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# fixed values: spellings of a truth value
TRUE_WORDS = ["true", "yes", "1"]
FALSE_WORDS = ["false", "no", "0"]


def coerce_bool(c) -> Column:
    """Nullable boolean of a spelling; anything else is null."""
    v = F.lower(F.trim(col(c)))
    return F.when(v.isin(TRUE_WORDS), F.lit(True)).when(v.isin(FALSE_WORDS), F.lit(False))


# fixed values: severity spellings of scanners
SEVERITIES = {
    "critical": ["critical", "严重", "危急"],
    "high": ["high", "error", "高危"],
    "medium": ["medium", "moderate", "warning", "warn", "中危"],
    "low": ["low", "低危"],
    "info": ["unknown", "undefined", "unassigned", "none", "informational", "note", "info", ""],
}
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1, "none": 0}


def normalize_severity(c) -> Column:
    s = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    out = F.when(s.isin(SEVERITIES["info"]), F.lit("info"))
    for level in ("critical", "high", "medium", "low"):
        out = out.when(s.isin(SEVERITIES[level]), F.lit(level))
    for level, parts in (("critical", "crit"), ("high", "high"), ("medium", "med|moderate|warn"), ("low", "low|info")):
        out = out.when(s.rlike(parts), F.lit(level))
    return out.otherwise(F.lit("info"))


def severity_rank(c) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])[col(c)], F.lit(0))


def entropy(c) -> Column:
    """Shannon entropy in bits of a short string's characters. For long texts group exploded characters instead."""
    chars = F.filter(F.split(col(c), ""), lambda x: x != "")
    n = F.size(chars)
    share = lambda x: F.size(F.filter(chars, lambda y: y == x)) / n
    return -F.aggregate(F.transform(F.array_distinct(chars), lambda x: share(x) * F.log2(share(x))), F.lit(0.0), lambda a, x: a + x)


# fixed values: values that are no secrets
WEAK_VALUES = r"(?i)^(?:dev[_-]?key|dev[_-]?secret|dev[_-]?token|test|testing|changeme|change[_-]?me|secret|password|passwd|pwd|admin|root|default|example|sample|dummy|placeholder|your[_-]?(?:secret|key|password)|xxx+|abc123|123456|demo|local|development)$"
PLACEHOLDER = r"(?i)(?:^|[_-])(?:dev|develop|development|test|testing|example|sample|dummy|placeholder|changeme|demo|local)(?:$|[_-])"


def is_strong_credential(c) -> Column:
    """Whether evidence quotes a value that looks like a real secret: long or random, not a known weak value; unquoted, a long key-like run."""
    text = F.coalesce(col(c), F.lit(""))
    value = F.regexp_extract(text, "[\"']([^\"']{4,})[\"']", 1)
    run = F.regexp_extract(value, "([A-Za-z0-9]{12,})", 1)
    random = (run != "") & run.rlike("[a-z]") & run.rlike("[A-Z0-9]")
    strong = ~value.rlike(WEAK_VALUES) & ~(value.rlike(PLACEHOLDER) & ~random) & (((F.length(value) >= 12) & (entropy(value) >= 3.0)) | (F.length(value) >= 20))
    return F.when(value == "", text.rlike("[A-Za-z0-9+/=]{20,}")).otherwise(strong)


def ratio(a, b) -> Column:
    """a / b, null for b = 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def wilson(successes, total, z: float = 1.96) -> Column:
    """Wilson interval as struct(low, high) in [0, 1] at 4 digits; null without trials."""
    n = F.nullif(col(total).cast("double"), F.lit(0.0))
    p = col(successes).cast("double") / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.struct(F.round(F.greatest(F.lit(0.0), mid - margin), 4).alias("low"), F.round(F.least(F.lit(1.0), mid + margin), 4).alias("high"))


def majority(true_count, false_count, total) -> Column:
    """Majority with a quorum: null unless over half the votes are valid; a tie is true."""
    valid = col(true_count) + col(false_count)
    return F.when((valid > 0) & (valid * 2 > col(total)), col(true_count) * 2 >= valid)


def hash_bucket(c, buckets: int = 100) -> Column:
    """A bucket from the last 8 hexadecimal digits of the MD5."""
    return (F.conv(F.right(F.md5(col(c).cast("string").cast("binary")), F.lit(8)), 16, 10).cast("long") % buckets).cast("int")
