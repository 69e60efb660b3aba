"""Rule scans over texts: pattern rules as data, line rules with propagation, chunk scores and patches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import text as T


class Rule:
    """A named rule: any of `patterns` must match and none of `excludes`; the class and severity it reports."""

    def __init__(self, name: str, patterns: list[str], excludes: list[str] = (), cwe: str = "", severity: str = "medium", safe: bool = False):
        self.name, self.patterns, self.excludes, self.cwe, self.severity, self.safe = name, patterns, list(excludes), cwe, severity, safe

    def hit(self, text: Column) -> Column:
        out = text.rlike("|".join(f"(?:{p})" for p in self.patterns))
        return out & ~text.rlike("|".join(f"(?:{p})" for p in self.excludes)) if self.excludes else out


# fixed values: patterns of usual dangerous and safe calls
RULES = [
    Rule("sql_concat", [r"(?i)execute\(\s*[\"'][^\"']*[\"']\s*(\+|%)", r"(?i)execute\(\s*f[\"']"], [r"(?i)execute\([^)]*,\s*\("], "CWE-89", "high"),
    Rule("os_command", [r"os\.system\(", r"subprocess\.[A-Za-z_]+\([^)]*shell\s*=\s*True", r"child_process\.exec\("], [], "CWE-78", "critical"),
    Rule("eval_input", [r"\beval\(", r"\bexec\(", r"new Function\("], [r"ast\.literal_eval"], "CWE-94", "critical"),
    Rule("unsafe_load", [r"pickle\.loads?\(", r"yaml\.load\(", r"unserialize\(", r"ObjectInputStream"], [r"SafeLoader"], "CWE-502", "high"),
    Rule("path_join", [r"open\([^)]*\+", r"os\.path\.join\([^)]*request"], [r"abspath\([^)]*\)[\s\S]*startswith"], "CWE-22", "high"),
    Rule("weak_hash", [r"(?i)\bmd5\(", r"(?i)\bsha1\("], [], "CWE-327", "medium"),
    Rule("weak_random", [r"random\.random\(", r"Math\.random\("], [r"secrets\."], "CWE-330", "low"),
    Rule("inner_html", [r"innerHTML\s*=", r"document\.write\(", r"v-html="], [r"DOMPurify"], "CWE-79", "medium"),
    Rule("open_redirect", [r"redirect\(\s*request"], [], "CWE-601", "medium"),
    Rule("server_request", [r"requests\.(get|post)\(\s*[a-z_]*url", r"urlopen\("], [], "CWE-918", "high"),
    Rule("hard_secret", [r"(?i)(password|secret|api_?key|token)\s*=\s*[\"'][^\"']{4,}[\"']"], [r"getenv|environ"], "CWE-798", "high"),
    Rule("xml_entity", [r"DocumentBuilderFactory", r"SAXParserFactory"], [r"disallow-doctype-decl"], "CWE-611", "high"),
    Rule("debug_on", [r"(?i)debug\s*=\s*True"], [], "CWE-489", "low"),
    Rule("tls_off", [r"verify\s*=\s*False", r"rejectUnauthorized:\s*false"], [], "CWE-295", "medium"),
    Rule("bound_query", [r"(?i)execute\(\s*[\"'][^\"']*(\?|%s)[^\"']*[\"']\s*,"], [], "", "none", safe=True),
]


def rule_hits(df: DataFrame, text: str, rules: list[Rule] = RULES) -> DataFrame:
    """df with hits: array<struct<rule, cwe, severity>> of the danger rules that match, and safe: whether a safe rule does. One pass, no join."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = [F.when(r.hit(t), F.struct(F.lit(r.name).alias("rule"), F.lit(r.cwe).alias("cwe"), F.lit(r.severity).alias("severity"))) for r in rules if not r.safe]
    safe = F.lit(False)
    for r in rules:
        if r.safe:
            safe = safe | r.hit(t)
    return df.withColumn("hits", F.array_compact(F.array(*found))).withColumn("safe", safe)


def rule_verdict(df: DataFrame, text: str, rules: list[Rule] = RULES, most_lines: int = 150, secret: str = r"(?i)password|secret|token") -> DataFrame:
    """df with verdict: true with a hit; false with a safe rule, few lines and no mark of a secret; else null."""
    found = rule_hits(df, text, rules)
    short = F.size(T.lines(text)) <= most_lines
    return found.withColumn("verdict", F.when(F.size("hits") > 0, F.lit(True)).when(F.col("safe") & short & ~F.coalesce(F.col(text), F.lit("")).rlike(secret), F.lit(False)))


def line_hits(df: DataFrame, key: str, text: str, rules: list[Rule] = RULES) -> DataFrame:
    """(key, line, rule): lines on which a danger rule's pattern stands."""
    lines = df.select(key, F.posexplode(T.lines(text)).alias("i", "line_text"))
    found = F.array_compact(F.array(*[F.when(F.col("line_text").rlike("|".join(f"(?:{p})" for p in r.patterns)), F.lit(r.name)) for r in rules if not r.safe]))
    return lines.select(key, (F.col("i") + 1).alias("line"), F.explode(found).alias("rule"))


def chunk_scores(df: DataFrame, key: str, text: str, sink: str, source: str, entry: str, size: int = 150) -> DataFrame:
    """(key, chunk, start, score, rank) of runs of `size` lines, scored by pattern counts, each up to 5."""
    ls = T.lines(text)
    starts = F.sequence(F.lit(0), F.greatest(F.size(ls) - 1, F.lit(0)), F.lit(size))
    chunks = df.select(key, F.posexplode(F.transform(starts, lambda s: F.struct((s + 1).alias("start"), F.array_join(F.slice(ls, s + 1, size), "\n").alias("t")))).alias("chunk", "c"))
    n = lambda p: F.least(F.regexp_count("c.t", F.lit(p)), F.lit(5))
    scored = chunks.select(key, "chunk", F.col("c.start").alias("start"), (n(sink) * 3 + n(source) * 2 + n(entry)).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "start")))


@udtf(returnType="source_line int, sink_line int, variable string, path string")
class TaintPaths:
    """Flows from a source call to a sink call through assignments of one text, read line by line: (source_line, sink_line, variable, path)."""

    def eval(self, code: str):
        import re

        if not code:
            return
        source = re.compile(r"\b(?:input|request\.[A-Za-z_.]+|argv|getParameter|params)\b")
        sink = re.compile(r"\b(?:execute|system|eval|exec|popen|open|redirect)\s*\(")
        clean = re.compile(r"\b(?:escape|quote|int|float|sanitize|literal_eval)\s*\(")
        assign = re.compile(r"^\s*([A-Za-z_]\w*)\s*=(?!=)\s*(.+)$")
        word = re.compile(r"[A-Za-z_]\w*")
        tainted: dict[str, list[int]] = {}
        for n, line in enumerate(code.split("\n"), 1):
            m = assign.match(line)
            if m:
                name, value = m.groups()
                via = [tainted[w] for w in word.findall(value) if w in tainted]
                if clean.search(value):
                    tainted.pop(name, None)
                elif source.search(value):
                    tainted[name] = [n]
                elif via:
                    tainted[name] = [*min(via, key=len), n]
                else:
                    tainted.pop(name, None)
            if sink.search(line):
                after = line[sink.search(line).end() :]
                for w in dict.fromkeys(word.findall(after)):
                    if w in tainted and not clean.search(after):
                        yield tainted[w][0], n, w, ">".join(map(str, [*tainted[w], n]))


def patch_lines(df: DataFrame, key: str, patch: str) -> DataFrame:
    """(key, hunk, tag, line, old_line, new_line) of unified diffs; numbers follow from the last hunk header above."""
    lines = df.select(key, F.posexplode(T.lines(patch)).alias("i", "raw"))
    head = F.regexp_extract("raw", r"^@@ -([0-9]+)", 1)
    new = F.regexp_extract("raw", r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)", 1)
    w = Window.partitionBy(key).orderBy("i")
    rows = lines.withColumns({"h": F.when(head != "", head.cast("int")), "n": F.when(head != "", new.cast("int"))})
    rows = rows.withColumns({"hunk": F.count("h").over(w), "h0": F.last("h", ignorenulls=True).over(w), "n0": F.last("n", ignorenulls=True).over(w)}).where("hunk > 0 AND h IS NULL AND raw RLIKE '^[-+ ]'")
    tag = F.substring("raw", 1, 1)
    before = Window.partitionBy(key, "hunk").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    olds, news = F.coalesce(F.sum((tag != "+").cast("int")).over(before), F.lit(0)), F.coalesce(F.sum((tag != "-").cast("int")).over(before), F.lit(0))
    return rows.select(key, F.col("hunk").cast("int").alias("hunk"), tag.alias("tag"), F.expr("substring(raw, 2)").alias("line"), F.when(tag != "+", F.col("h0") + olds).cast("int").alias("old_line"), F.when(tag != "-", F.col("n0") + news).cast("int").alias("new_line"))


def apply_patches(df: DataFrame, key: str, text: str, patch: str, reach: int = 200) -> DataFrame:
    """(key, patched): texts with their unified diffs applied, each hunk where its old lines stand, searched up to `reach` lines around; null if one isn't found."""
    import re

    header = re.compile(r"^@@ -(\d+)")

    def one(code: str | None, diff: str | None) -> str | None:
        lines, hunks = (code or "").split("\n"), []
        for raw in (diff or "").split("\n"):
            m = header.match(raw)
            if m:
                hunks.append((int(m.group(1)), [], []))
            elif hunks and raw[:1] in (" ", "-", "+"):
                if raw[0] != "+":
                    hunks[-1][1].append(raw[1:])
                if raw[0] != "-":
                    hunks[-1][2].append(raw[1:])
        for start, old, new in reversed(hunks):
            spots = sorted((abs(d), start - 1 + d) for d in range(-reach, reach + 1))
            at = next((p for _, p in spots if 0 <= p <= len(lines) - len(old) and lines[p : p + len(old)] == old), None)
            if at is None:
                return None
            lines[at : at + len(old)] = new
        return "\n".join(lines)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({key: p[key], "patched": [one(a, b) for a, b in zip(p[text], p[patch], strict=True)]})

    return df.select(key, text, patch).mapInPandas(run, f"{key} bigint, patched string")
