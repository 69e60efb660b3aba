import difflib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillmill.operators import budget as B
from quillmill.operators import fixes as X


def plain_hints(old, new):
    """Read off a unified diff with one line of context."""
    a, b = old.splitlines(), new.splitlines()
    if not a or not b:
        return [], True
    blocks, out, review = [], [], False
    for line in list(difflib.unified_diff(a, b, n=1, lineterm=""))[2:]:
        if m := re.match(r"@@ -(\d+)", line):
            blocks.append((int(m.group(1)), [], []))
        elif line[0] in "+-":
            blocks[-1][1 if line[0] == "-" else 2].append(line[1:])
    for at, gone, adds in blocks:
        if len(adds) == 1 and len(gone) <= 1:
            out.append(f"line {at}: " + ("应改为 " if gone else "建议插入 ") + adds[0].strip())
        elif adds:
            out.append(f"line {at}: 应改为 {adds[0].strip()}" + (f"（另 {len(adds) - 1} 行，见完整改法）" if len(adds) > 1 else ""))
            review = True
        else:
            out.append(f"line {at}: 建议删除该行（{gone[0].strip()}）")
            review = True
    return out, review


def revised(rng):
    old = [f"  line {rng.randrange(12)} x" for _ in range(rng.randrange(0, 25))]
    new = list(old)
    for _ in range(rng.randrange(5)):
        at = rng.randrange(len(new) + 1)
        new[at : at + rng.randrange(3)] = [f"\tnew {rng.randrange(9)} "] * rng.randrange(3)
    return "\n".join(old), "\n".join(new)


def test_hints_against_a_unified_diff(spark):
    rng = random.Random(3)
    pairs = [(i, *revised(rng)) for i in range(300)] + [(900, None, "x"), (901, "x", ""), (902, "same", "same")]
    got = {r.k: (r.hints, r.needs_review) for r in X.localized(spark.createDataFrame(pairs, "k int, a string, b string"), ["k"], "a", "b").collect()}
    assert got[900] == ([], True) and got[901] == ([], True) and got[902] == ([], False)
    for k, a, b in pairs[:300]:
        want = plain_hints(a, b)
        assert got[k] == want, (a, b)


def test_gates(spark):
    rows = [
        (1, "q = run(sql + name)\n", "q = run(sql, [name])  # escape(\nq = bindParam(name)\n", "89", "SQL injection through the name name parameter"),
        (2, "a\n", "a\n# only a remark\n", "89", "nothing alike"),
        (3, "a\n", "a\nSELECT 1\n", "89", "statement of words"),
        (4, "a\n", "b\n", "1", ""),
        (5, None, "b\n", None, None),
        (6, "x = 1\ny\n", "x = 2\ny\n", "89", "x"),
        (7, "like concat\n", "other\n", "89", "concat other words"),
    ]
    words = spark.createDataFrame([("89", "sql"), ("89", "query"), ("89", "select"), ("22", "path")], "label string, word string")
    proofs = spark.createDataFrame([("89", True, r"\bselect\b"), ("89", True, r"run\(sql"), ("89", False, "concat")], "label string, strong boolean, pattern string")
    df = spark.createDataFrame(rows, "k int, a string, b string, c string, d string")
    got = {r.k: (r.gate_a, r.gate_b, r.gate_c, r.defences) for r in X.gates(df, ["k"], "a", "b", "c", "d", words, proofs).collect()}
    assert got == {1: ("pass", "pass", "pass", 2), 2: ("fail", "fail", "pending_lead", 0), 3: ("warn", "pass", "missing_type", 0), 4: ("n/a", "pass", "no_vocab", 0), 5: ("n/a", "fail", "n/a", 0), 6: ("fail", "pass", "pending_lead", 0), 7: ("warn", "pass", "weak", 0)}


def test_top_words(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Alpha", "beta", "the", "gamma-ray", "x1", "delta_2", "eps"] + [f"w{i}" for i in range(20)]) for _ in range(60)) for _ in range(30)]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", X.top_words(F.col("t")).alias("w")).collect()
    for r in got:
        low = [w.lower() for w in re.findall(X.WORD, texts[r.k]) if w.lower() not in X.STOP]
        assert r.w == [w for w, _ in Counter(low).most_common(12)]


def plain_fold(rows, most, most_rows=None):
    chosen, used, taken = set(), Counter(), Counter()
    for k, g, _, n in sorted(rows, key=lambda r: (-r[2], r[0])):
        if (most_rows is None or taken[g] < most_rows) and (not taken[g] or used[g] + (n or 0) <= most):
            chosen.add(k)
            used[g] += n or 0
            taken[g] += 1
    return chosen


def test_budget_equals_the_fold_on_any_partitioning(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "b", "c", None]), rng.randrange(40), rng.choice([0, 1, 3, 30, 300, 3000, None, rng.randrange(900)])) for i in range(3000)]
    rows += [(9000, "huge", 1, 10**9), (9001, "huge", 0, 1), (9002, "zero", 1, 0), (9003, "zero", 0, 10**9)]
    for parts, most, most_rows in ((1, 9000, None), (13, 9000, 40), (40, 1, None), (5, 10**7, 7)):
        df = spark.createDataFrame(rows, "k int, g string, s int, n int").repartition(parts)
        got = B.char_budget(df, "g", ["s", "k"], "n", most, [False, True], most_rows)
        assert got.columns == ["k", "g", "s", "n", "selected"]
        found = got.collect()
        assert len(found) == len(rows) and {r.k for r in found if r.selected} == plain_fold(rows, most, most_rows)


def test_budget_of_an_empty_table(spark):
    assert B.char_budget(spark.createDataFrame([], "k int, g string, s int, n int"), "g", ["s"], "n", 10, [True]).count() == 0
