import random
import re

import numpy as np
import xxhash

from quillmill.llm import simhash_pivots as P
from quillmill.llm.banding import BITS, bands

from .helpers import AWKWARD, DOCS, docs, stored


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode("utf-8"), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, most=2):
    comp = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= most and comp[i] != comp[j]:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    return comp


def check(spark, tmp_path, rows, name="docs", **kw):
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    comp = plain_components(prints)
    least = {}
    for c, (i, *_) in zip(comp, rows, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i, f"{p:016x}", least.get(c)) for (i, *_), p, c in zip(rows, prints, comp, strict=True)), key=str)
    got = P.simhash_components(stored(spark, tmp_path, docs(spark, rows), name), **kw).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    return got


def test_awkward_rows(spark, tmp_path):
    check(spark, tmp_path, AWKWARD)


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 30, 400]))] for _ in range(60)]
    rows = []
    for i in range(300):
        w = rng.choice(base)[:]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w).replace("w1", "W1"), "en", "s"))
    rows += [rows[7]] * 50
    got = check(spark, tmp_path, rows)
    assert len({r.component_id for r in got}) < len({r.fingerprint for r in got}) < 300


def test_a_text_longer_than_a_piece(monkeypatch):
    rng = random.Random(9)
    text = "  ".join(rng.choice(["Alpha", "beta", "é", "x" * 50, "\t"]) for _ in range(3000))
    monkeypatch.setattr(P, "SLAB", 64)
    assert P.fingerprint(text.encode()) == plain_fingerprint(text)
    for few in ("", " \n", "One", " one  two ", "a" * 1000 + " b", "one two three"):
        assert P.fingerprint(few.encode()) == plain_fingerprint(few)


def families(rng, many):
    out = set()
    for _ in range(many):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 400])):
            out.add(base ^ sum(1 << b for b in rng.sample(range(12), rng.randrange(4))))
    return sorted(out)


def test_groups_that_are_cut_again_lose_no_link(spark, tmp_path):
    prints = families(random.Random(1), 12)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = stored(spark, tmp_path, spark.createDataFrame([(p,) for p in signed], "mask bigint"))
    want = len(set(plain_components(prints)))
    for limit in (1 << 20, 30, 3):
        parent = {p: p for p in signed}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in P.fingerprint_links(table, limit=limit).collect():
            assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2
            parent[find(r.a)] = find(r.b)
        assert len({find(p) for p in signed}) == want


def test_the_pivot_table_discards_no_close_pair():
    rng = random.Random(5)
    prints = np.array(families(rng, 6), np.uint64)
    got = {tuple(sorted((i, j))) for a, b in P.close_pairs(prints) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if int(prints[i] ^ prints[j]).bit_count() <= 2}


def test_equal_bands_have_equal_pivot_differences():
    rng = random.Random(7)
    for band in bands(BITS):
        a = np.array([rng.getrandbits(64) for _ in range(200)], np.uint64)
        noise = np.array([rng.getrandbits(64) for _ in range(200)], np.uint64) & ~np.uint64(sum(1 << b for b in band))
        assert (P.band_key(a, band) == P.band_key(a ^ noise, band)).all()


def test_empty_table_other_columns_and_dedup(spark, tmp_path):
    empty = stored(spark, tmp_path, spark.createDataFrame([], DOCS), "none")
    assert P.simhash_components(empty).count() == 0 and P.near_dedup(empty).count() == 0
    clash = stored(spark, tmp_path, docs(spark).withColumnRenamed("lang", "mask").withColumnRenamed("source", "component").withColumnRenamed("n_chars", "rid"), "clash")
    left = P.near_dedup(clash)
    assert left.columns == clash.columns and left.count() == len({(c) for c in plain_components([plain_fingerprint(t) for _, t, *_ in AWKWARD])})
