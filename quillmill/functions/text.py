"""Column functions on texts: normal forms, fingerprints, hashes, token estimates, extraction. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t\n\x0B\f\r ]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_code(c) -> Column:
    """White space runs become one space; trimmed."""
    return F.trim(F.regexp_replace(col(c), WS, " "))


def lines(c) -> Column:
    return F.split(F.coalesce(col(c), F.lit("")), "\n")


def norm_lines(c) -> Column:
    """Distinct lines, lower-cased and trimmed, without comments (# or //) and those under 8 characters."""
    t = F.transform(lines(c), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(t, lambda x: (F.length(x) >= 8) & ~x.startswith("#") & ~x.startswith("//")))


#: Around what stands alone: no letter or digit of any script and no underscore beside it.
ALONE = (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])")


def norm_lines_masked(c) -> Column:
    """Lines in order without comments, string literals as S and numbers as N, of 4 characters or more."""
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/)", " ")
    t = F.regexp_replace(t, r"\"[^\"\n]*\"|'[^'\n]*'", "S")
    t = F.regexp_replace(t, rf"{ALONE[0]}[0-9]+{ALONE[1]}", "N")
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 4)


def skeleton(c, keep: list[str]) -> Column:
    """Words outside keep become ID."""
    words = F.array(*[F.lit(k) for k in keep])
    parts = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[A-Za-z_]") & ~F.array_contains(words, F.lower(x)), F.lit("ID")).otherwise(x)), "")


# fixed values: comment prefixes
COMMENT_PREFIXES = ["#", "//", "/*", "*", "--", ";", "<!--"]


def structural_lines(c) -> Column:
    def comment(x: Column) -> Column:
        out = F.lit(False)
        for p in COMMENT_PREFIXES:
            out = out | x.startswith(p)
        return out

    kept = F.filter(F.transform(lines(c), lambda x: F.trim(F.regexp_replace(x, r"[\t\x0B\f\r]", " "))), lambda x: (F.length(x) > 0) & ~comment(x))

    def mask(x: Column) -> Column:
        x = F.regexp_replace(x, r'"[^"]*"', '""')
        x = F.regexp_replace(x, r"'[^']*'", "''")
        x = F.regexp_replace(x, r"`[^`]*`", "``")
        return F.regexp_replace(F.regexp_replace(x, r"[0-9]+", "0"), WS, "")

    return F.filter(F.transform(kept, mask), lambda x: F.length(x) > 0)


def structural_fingerprint(c) -> Column:
    """MD5 of the text without comments, literals' contents, numbers and white space."""
    return F.md5(F.array_join(structural_lines(c), "\n").cast("binary"))


# fixed values: variable names that a form masks
FORM_VARIABLES = ["user_input", "userInput", "username", "password", "email", "search_term", "searchTerm", "comment", "name", "value", "data", "query", "id", "uid", "file", "content", "message", "input", "param", "request", "payload", "token", "url", "cmd"]


def normalize_form(c) -> Column:
    """A line's form: literals, numbers and usual variable names masked; 120 characters at most."""
    t = F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"'[^']*'", "'S'"), r'"[^"]*"', '"S"')
    t = F.regexp_replace(t, rf"{ALONE[0]}[0-9]+{ALONE[1]}", "N")
    t = F.regexp_replace(t, f"(?i){ALONE[0]}(" + "|".join(FORM_VARIABLES) + f"){ALONE[1]}", "VAR")
    return F.left(F.regexp_replace(t, WS, " "), F.lit(120))


def patch_line(c) -> Column:
    """A patch line without literals and numbers, 160 characters at most."""
    t = F.regexp_replace(col(c), r"\"[^\"]*\"|'[^']*'|`[^`]*`", '""')
    return F.left(normalize_code(F.regexp_replace(t, r"\b[0-9]+\b", "N")), F.lit(160))


def api_shapes(c) -> Column:
    """Lower-cased last two parts of what is called in a line, of 3 characters or more."""
    calls = F.regexp_extract_all(col(c), F.lit(r"([A-Za-z0-9_.$]+)[ ]*\("), 1)
    tails = F.transform(calls, lambda x: F.lower(F.array_join(F.slice(F.split(x, r"\."), F.greatest(F.lit(1), F.size(F.split(x, r"\.")) - 1), 2), ".")))
    return F.filter(tails, lambda x: F.length(x) >= 3)


def tokens(c, least: int = 2) -> Column:
    """Distinct runs of [a-zA-Z0-9_] of `least` characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(f"([a-zA-Z0-9_]{{{least},}})"), 1))


def head_tail_hash(c, n: int = 200) -> Column:
    """MD5 of the first and last n characters, of all of a text of up to 2n."""
    t = F.coalesce(col(c), F.lit(""))
    return F.md5(F.when(F.length(t) <= 2 * n, t).otherwise(F.concat(F.left(t, F.lit(n)), F.right(t, F.lit(n)))).cast("binary"))


def sliding_windows(c, width: int = 200, step: int = 100) -> Column:
    """Windows of width characters every step characters; the whole text if it is shorter."""
    t = col(c)
    return F.when(F.length(t) >= width, F.transform(F.sequence(F.lit(1), F.length(t) - width + 1, F.lit(step)), lambda i: F.substring(t, i, F.lit(width)))).otherwise(F.array(t))


def cjk(c) -> Column:
    return F.length(col(c)) - F.length(F.regexp_replace(col(c), "[一-鿿]", ""))


def token_estimates(c) -> dict[str, Column]:
    """Four linear estimates of token counts from Chinese and other characters."""
    z, r = cjk(c), F.length(F.regexp_replace(col(c), "[一-鿿]", ""))
    return {"est_a": z / 1.5 + r / 4.0, "est_b": 1.616 * z + 0.240 * r, "est_c": z * 1.5 + r / 4.0, "est_d": 0.85 * z + 0.28 * r}


def cwe_list(c) -> Column:
    """Distinct CWE numbers of a string, upper case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit("(?i)(CWE-[0-9]+)"), 1), lambda x: F.upper(x))))


def last_json_block(c) -> Column:
    """The text of the last fenced json block, else null."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(?s)```json\s*(.*?)\s*```"), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def analysis_body(c) -> Column:
    return F.substring_index(col(c), "```json", 1)


def strip_code(c) -> Column:
    """Fences keep their language and lose their content."""
    return F.regexp_replace(col(c), r"(?s)```([A-Za-z]*)\n.*?```", "```$1```")


def reasoning_steps(c) -> Column:
    """The most of numbered lines and `step n` marks."""
    numbered = F.size(F.regexp_extract_all(col(c), F.lit(r"(?:^|\n)\s*([0-9]+)[.)、]"), 1))
    named = F.size(F.regexp_extract_all(col(c), F.lit(r"步骤\s*([0-9]+)"), 1))
    return F.greatest(numbered, named)


def line_refs(c) -> Column:
    """Line numbers cited as `line n`, `第 n 行` or Ln, in that order."""
    parts = [r"第\s*([0-9]+)\s*行", r"[Ll]ine\s+([0-9]+)", r"\bL([0-9]+)\b"]
    return F.transform(F.concat(*[F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(p), 1) for p in parts]), lambda x: x.cast("int"))


def with_line_numbers(c) -> Column:
    return F.array_join(F.transform(lines(c), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")


def line_context(c, line, radius: int) -> Column:
    """Lines line - radius to line + radius (1-based), joined."""
    ls, n = lines(c), col(line)
    start = F.greatest(F.lit(1), n - radius)
    return F.array_join(F.slice(ls, start, F.greatest(F.lit(0), F.least(F.size(ls), n + radius) - start + 1)), "\n")


def is_minified(c) -> Column:
    """At least 4096 characters, and a source map mark near the end, lines of over 250 characters on average, or half the lines over 2000."""
    t, ls = F.coalesce(col(c), F.lit("")), lines(c)
    n = F.size(ls)
    long_ = F.size(F.filter(ls, lambda x: F.length(x) > 2000))
    return (F.length(t) >= 4096) & (F.contains(F.right(t, F.lit(4000)), F.lit("sourceMappingURL=")) | (F.length(t) / n > 250) | (long_ >= F.greatest(F.lit(1), F.floor(n / 2))))


def paragraph_pack(c, most: int) -> Column:
    """Whole paragraphs from the start while they fit in `most` characters; the first is cut if it alone doesn't."""
    ps = F.split(F.coalesce(col(c), F.lit("")), "\n\n")
    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("full"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["t"] == "", p).otherwise(F.concat(acc["t"], F.lit("\n\n"), p))
        fits = ~acc["full"] & (F.length(joined) <= most)
        return F.struct(F.when(fits, joined).otherwise(acc["t"]).alias("t"), (~fits).alias("full"))

    packed = F.aggregate(ps, start, step, lambda acc: acc["t"])
    return F.when(packed == "", F.left(F.coalesce(col(c), F.lit("")), F.lit(most))).otherwise(packed)


#: Texts of an Arrow batch that are Python objects at once.
SLICE = 128


def by_slices(f, kind, *columns):
    """An Arrow array of `kind` of f over the rows of Arrow arrays: only SLICE rows at a time are Python objects, whatever a batch holds."""
    import pyarrow as pa

    made = [pa.array([f(*row) for row in zip(*(c.slice(at, SLICE).to_pylist() for c in columns), strict=True)], kind) for at in range(0, len(columns[0]), SLICE)]
    return pa.concat_arrays(made) if made else pa.array([], kind)
