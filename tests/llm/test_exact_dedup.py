import hashlib
import random
from collections import defaultdict

from quillmill.llm import exact_dedup as E

from .helpers import AWKWARD, DOCS, docs, stored


def expected(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = []
    for i, t, *_ in rows:
        g = groups[t or ""]
        ids = [x for x in g if x is not None]
        out.append((i, max(ids) if ids else None, len(g), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, tmp_path, rows, **kw):
    found = E.exact_groups(stored(spark, tmp_path, docs(spark, rows)), **kw).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == expected(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({t or "" for _, t, *_ in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_awkward_rows(spark, tmp_path):
    check(spark, tmp_path, AWKWARD)


def test_many_levels_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.choice([0, 3, 7, 8, 9, 40, 200]))), "en", "s") for i in range(300)]
    rows += [(1000 + i, rows[rng.randrange(300)][1], "en", "s") for i in range(200)]
    check(spark, tmp_path, rows, block_chars=4)


def test_names_are_equal_for_equal_texts_only(spark, tmp_path):
    rows = [(1, "aaaabbbb", "", ""), (2, "aaaa", "", ""), (3, "bbbb", "", ""), (4, "bbbbaaaa", "", ""), (5, "aaaabbbb", "", ""), (6, "aaaabbbbaaaa", "", "")]
    names = {r.doc_id: (r.n, r.name) for r in E.name_documents(stored(spark, tmp_path, docs(spark, rows)), block_chars=4).collect()}
    assert names[1] == names[5] and len(set(names.values())) == 5


def test_empty_table_and_other_columns(spark, tmp_path):
    empty = stored(spark, tmp_path, spark.createDataFrame([], DOCS), "none")
    assert E.exact_groups(empty).count() == 0
    assert E.exact_dedup(empty).count() == 0
    clash = stored(spark, tmp_path, docs(spark).withColumnRenamed("lang", "name").withColumnRenamed("source", "n"), "clash")
    kept = E.exact_dedup(clash)
    assert kept.columns == clash.columns and kept.count() == len({t or "" for _, t, *_ in AWKWARD})
