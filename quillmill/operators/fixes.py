"""What a revision changed, as hunks, hints by line and gates.

Both texts of a pair stand in one row: hunks come from matching blocks of lines, whose memory is linear in the lines, and nothing is
shuffled. Hints and gates are column expressions over the hunks; words and evidence by class come as rows and are joined by class.

Defined results: a null or empty text on either side gives no hunks (a pair without hunks needs review if a side is empty, else it changed nothing); equal pairs of
rows give equal hunks; lines are cut as str.splitlines does.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words that tell nothing, what begins a comment, marks of a defence, and the wording of a hint
STOP = """the a an of in to for and or is are was were be been being with by on at as that this it its
from via when if not no nor can could may might will would shall should must do does did done have has had
allow allows allowing attacker attackers user users version versions fixed fixes fix patched patch issue bug
cve code craft crafted crafting leads lead leading results result resulting due because which who whom what
into onto out up down all any some more most less least then than also only just about after before between
during through under over again further once here there where why how both each few other such own same so
too very s t don now his her their our your my me he she they them we you i
new old use used using uses make makes made set sets get gets got obtain obtained
while until against within without upon per among across since""".split()
COMMENTS = ("//", "#", "/*", "*", "--", '"""', "'''")
DEFENCE = (
    r"(?i)(sanitize|escapeshell|shlex\.quote|htmlspecialchars|htmlentities|escapeshellarg|escapeshellcmd|parameteri|prepare\s*\(|bindValue|bindParam|placeholder|whitelist|allowlist|allow_list"
    r"|realpath|basename|canonicaliz|validate|verif|csrf|xsrf|nonce|EscapeFilter|escape_filter|addslashes|preg_quote|htmlsafe|MarkSafe|autoescape|escape\s*\(|quote\s*\(|encode"
    r"|InsecureSkipVerify\s*:\s*false|rejectUnauthorized\s*:\s*true|strict|frozen|readonly|permission|authoriz|authenticat|limit|timeout|integrity|checksum|sameSite)"
)
CHANGE, INSERT, DELETE, MORE = "应改为 ", "建议插入 ", ("建议删除该行（", "）"), ("（另 ", " 行，见完整改法）")
WORD = r"[a-zA-Z][a-zA-Z0-9_-]{2,}"
TOP_WORDS, ENOUGH = 12, 3


def hunks_of(old: str | None, new: str | None, context: int = 1) -> list[tuple[int, list[str], list[str]]]:
    """(first line of the hunk in the old text, context included, removed lines, added lines). Changes up to twice the context apart are one hunk."""
    a, b = (old or "").splitlines(), (new or "").splitlines()
    if not a or not b:
        return []
    out = []
    for group in SequenceMatcher(None, a, b).get_grouped_opcodes(context):
        first, last = group[0][1], group[-1][2]
        changed = [x for x in group if x[0] != "equal"]
        out.append((first + (last > first), [line for _, i, j, _, _ in changed for line in a[i:j]], [line for _, _, _, i, j in changed for line in b[i:j]]))
    return out


def hunks(df: DataFrame, keys: list[str], old: str, new: str, context: int = 1) -> DataFrame:
    """(keys, hunk from 1, line, removed, added): the hunks that turn old into new, one a row."""
    kinds = [(k, df.schema[k].dataType.simpleString()) for k in keys]
    names = ["hunk", "line", "removed", "added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (a, b) in enumerate(zip(batch.column(len(keys)), batch.column(len(keys) + 1), strict=True)):
                found = hunks_of(a.as_py(), b.as_py(), context)
                at += [i] * len(found)
                rows += [(n, *h) for n, h in enumerate(found, 1)]
            lines = pa.list_(pa.string())
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), lines, lines))]
            own = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, *cols], names=[*keys, *names])

    schema = ", ".join(f"`{k}` {t}" for k, t in kinds) + ", hunk int, line int, removed array<string>, added array<string>"
    return df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{old}`").alias("__old"), F.col(f"`{new}`").alias("__new")).mapInArrow(run, schema)


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def hint() -> tuple[Column, Column]:
    """The hint of a hunk, anchored at its line, and whether a person should look at it: anything but one line for one or for none."""
    n, gone = F.size("added"), F.size("removed")
    first = _bare(F.element_at("added", 1))
    more = F.when(n == 1, "").otherwise(F.concat(F.lit(MORE[0]), n - 1, F.lit(MORE[1])))
    text = F.when((n == 1) & (gone == 0), F.concat(F.lit(INSERT), first)).when(n > 0, F.concat(F.lit(CHANGE), first, more)).otherwise(F.concat(F.lit(DELETE[0]), _bare(F.element_at("removed", 1)), F.lit(DELETE[1])))
    return F.concat(F.lit("line "), F.col("line"), F.lit(": "), text), ~((n == 1) & (gone <= 1))


def localized(df: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """(keys, hints, needs_review) for every pair: its hints in order of lines."""
    text, review = hint()
    found = hunks(df, keys, old, new).withColumns({"__t": text, "__r": review})
    each = found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("hunk", "__t"))), lambda x: x["__t"]).alias("hints"), F.bool_or("__r").alias("needs_review"))
    empty = lambda c: F.coalesce(F.length(F.col(f"`{c}`")), F.lit(0)) == 0
    pairs = df.select(*keys, (empty(old) | empty(new)).alias("__e")).groupBy(*keys).agg(F.bool_or("__e").alias("__e"))
    none = F.array().cast("array<string>")
    return pairs.join(each, keys, "left").select(*keys, F.coalesce("hints", none).alias("hints"), F.coalesce("needs_review", "__e").alias("needs_review"))


def effective(line: Column) -> Column:
    """Whether a line is more than a comment."""
    bare, out = _bare(line), F.lit(False)
    for c in COMMENTS:
        out = out | bare.startswith(c)
    return (bare != "") & ~out


def top_words(text: Column, many: int = TOP_WORDS) -> Column:
    """The most frequent words of a text, of equal ones the first to occur."""
    low = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0), F.lower), lambda w: ~w.isin(*STOP))
    ranked = F.array_sort(F.transform(F.array_distinct(low), lambda w: F.struct((-F.size(F.filter(low, lambda x: x == w))).alias("n"), F.array_position(low, w).alias("i"), w.alias("w"))))
    return F.transform(F.slice(ranked, 1, many), lambda r: r["w"])


def gates(df: DataFrame, keys: list[str], old: str, new: str, label: str, description: str, words: DataFrame, evidence: DataFrame) -> DataFrame:
    """(keys, gate_a, gate_b, gate_c, defences) of every pair of texts with a class and a description.

    words: (label, word) of how a class works; evidence: (label, strong boolean, pattern) of what must stand in a text of the class.
    A: do changed lines hold words of the class or the most frequent ones of the description (fail: none, warn: under three, n/a: no description). B: is a line
    added that is more than a comment. C: is evidence found in the old text (pass: strong, weak, pending_lead: none, missing_type: only in what is added,
    no_vocab: none is known). defences: added lines with a mark of a defence. The pairs' keys should be unique.
    """
    found = hunks(df, keys, old, new).groupBy(*keys).agg(F.flatten(F.collect_list("removed")).alias("__gone"), F.flatten(F.collect_list("added")).alias("__adds"))
    rows = df.select(*keys, F.col(f"`{label}`").alias("__label"), F.col(f"`{description}`").alias("__about"), F.coalesce(F.col(f"`{old}`"), F.lit("")).alias("__old")).join(found, keys, "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"__gone": F.coalesce("__gone", none), "__adds": F.coalesce("__adds", none)})
    by_class = words.groupBy(F.col("label").alias("__label")).agg(F.array_sort(F.collect_set(F.lower("word"))).alias("__words"))
    proofs = evidence.groupBy(F.col("label").alias("__label")).agg(F.collect_list(F.struct("strong", "pattern")).alias("__proofs"))
    rows = rows.join(by_class, "__label", "left").join(proofs, "__label", "left")
    blob = F.lower(F.array_join(F.concat("__gone", "__adds"), "\n"))
    whole = lambda w: F.regexp_count(blob, F.concat(F.lit(r"(?<![a-z])\Q"), w, F.lit(r"\E(?![a-z])"))) > 0
    hits = F.size(F.filter(F.coalesce("__words", none), whole)) + F.size(F.filter(top_words(F.col("__about")), lambda w: F.contains(blob, w)))
    about = F.coalesce("__about", F.lit(""))
    a = F.when(about == "", "n/a").when(~F.exists(F.concat("__gone", "__adds"), lambda x: _bare(x) != ""), "fail").when(hits == 0, "fail").when(hits < ENOUGH, "warn").otherwise("pass")
    b = F.when(F.exists("__adds", effective), "pass").otherwise("fail")
    adds = F.array_join("__adds", "\n")
    told = lambda text, strong: F.exists("__proofs", lambda p: (p["strong"] == strong) & (F.regexp_count(text, F.concat(F.lit("(?i)"), p["pattern"])) > 0))
    c = F.when(F.col("__label").isNull(), "n/a").when(F.col("__proofs").isNull(), "no_vocab").when(told(F.col("__old"), True), "pass").when(told(F.col("__old"), False), "weak").when(told(adds, True), "missing_type").otherwise("pending_lead")
    return rows.select(*keys, a.alias("gate_a"), b.alias("gate_b"), c.alias("gate_c"), F.size(F.filter("__adds", lambda x: x.rlike(DEFENCE))).alias("defences"))
