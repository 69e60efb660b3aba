"""Pattern rules as rows of a table, searched in one scan however many they are: secrets, dangerous calls, any mark that a pattern can tell.

A rule is a row: rule, pattern (what it reports is the pattern's first group, or all of it), keywords (lower case; the pattern is tried only in texts
that hold one of them; none: in all), unless (a text with one of these patterns is left alone), allow (a value with one of these is no hit), entropy (least
Shannon entropy of a value in bits a character; null: any), label, severity. A further rule is a further row.

All keywords stand in one automaton, which reads each text once and names the rules whose patterns are to be tried. Rules go to every task, so their
number is checked first; texts aren't shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import RULES

SCHEMA = "rule string, pattern string, keywords array<string>, unless array<string>, allow array<string>, entropy double, label string, severity string"
MOST_RULES = 20_000

# fixed values: forms of secrets. rule, pattern, keywords, allowed values, least entropy
SECRETS = [
    ("aws-access-key-id", r"\b((?:A3T[A-Z0-9]|AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16})\b", ["a3t", "akia", "asia", "abia", "acca"], [], None),
    ("bytes-literal-secret", r"(?i)\b[\w-]*(?:secret|token|password|passwd|api[_-]?key|credential|access[_-]?key|private[_-]?key)[\w-]*\s*=\s*b['\"]([^'\"]{8,})['\"]", ["secret", "token", "password", "passwd", "api", "credential", "access", "private"], [], None),
    ("assigned-secret", r"(?i)\b[\w-]*(?:secret|token|password|passwd|api[_-]?key)[\w-]*\s*[=:]\s*['\"]([^'\"\s]{8,})['\"]", ["secret", "token", "password", "passwd", "api"], [r"(?i)example|changeme|placeholder|^(.)\1*$"], 3.0),
    ("private-key-block", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", ["private key"], [], None),
    ("json-web-token", r"\b(eyJ[\w-]{10,}\.eyJ[\w-]{10,}\.[\w-]{10,})", ["eyj"], [], None),
]


def secret_rules(spark: SparkSession) -> DataFrame:
    rows = [(r, p, k, [], a, e, "CWE-798", "high") for r, p, k, a, e in SECRETS]
    return spark.createDataFrame(rows, SCHEMA)


def danger_rules(spark: SparkSession) -> DataFrame:
    """The danger rules of operators.scan as rows, one a pattern."""
    rows = [(r.name, p, [], r.excludes, [], None, r.cwe, r.severity) for r in RULES if not r.safe for p in r.patterns]
    return spark.createDataFrame(rows, SCHEMA)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values()) if n else 0.0


class Scanner:
    """Rules made ready for a task."""

    def __init__(self, rows: list[dict]):
        self.rows = [(r, re.compile(r["pattern"]), [re.compile(x) for x in r["unless"] or ()], [re.compile(x) for x in r["allow"] or ()]) for r in rows]
        self.always = [i for i, (r, *_) in enumerate(self.rows) if not r["keywords"]]
        by_word: dict[str, list[int]] = {}
        for i, (r, *_) in enumerate(self.rows):
            for w in r["keywords"] or ():
                by_word.setdefault(w.lower(), []).append(i)
        self.words = ahocorasick.Automaton()
        for w, at in by_word.items():
            self.words.add_word(w, tuple(at))
        if by_word:
            self.words.make_automaton()
        self.any = bool(by_word)

    def hits(self, text: str) -> Iterator[tuple[int, int, int, str]]:
        """(rule's number, line from 1, position from 0, value), by rule and position."""
        wanted = set(self.always)
        if self.any:
            for _, at in self.words.iter(text.lower()):
                wanted.update(at)
        starts = None
        for i in sorted(wanted):
            rule, pattern, unless, allow = self.rows[i]
            found = None
            for m in pattern.finditer(text):
                value = m.group(1) if pattern.groups else m.group()
                if not value or any(a.search(value) for a in allow) or (rule["entropy"] is not None and entropy(value) < rule["entropy"]):
                    continue
                if found is None and any(u.search(text) for u in unless):
                    break
                found = True
                if starts is None:
                    starts = [0, *(x.end() for x in re.finditer("\n", text))]
                yield i, bisect_right(starts, m.start()), m.start(1 if pattern.groups else 0), value


def scan(df: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, rule, label, severity, line, start, value): every hit of every rule in whole texts. Null texts have none; equal rows give equal hits.

    The same place is reported once a rule, whatever number of its patterns tell it.
    """
    rows = [r.asDict() for r in rules.select(*[x.split(" ")[0] for x in SCHEMA.split(", ")]).orderBy("rule", "pattern").limit(MOST_RULES + 1).collect()]
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rows)
        for batch in batches:
            at, out = [], []
            for j, t in enumerate(batch.column(1)):
                if t.is_valid:
                    told = set()
                    for i, line, start, value in scanner.hits(t.as_py()):
                        r = rows[i]
                        if (r["rule"], start, value) not in told:
                            told.add((r["rule"], start, value))
                            at.append(j)
                            out.append((r["rule"], r["label"], r["severity"], line, start, value))
            names = ["rule", "label", "severity", "line", "start", "value"]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            cols = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], names=[batch.schema.names[0], *names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, rule string, label string, severity string, line int, start int, value string")
