import random

import numpy as np
import pytest

from quillmill.llm import ngram_join as N

from .helpers import DOCS, AWKWARD, docs, stored


def words(text):
    return (text or "").encode().lower().split()


def grams(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = [grams(t, k) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    comp = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            comp[find(i)] = min(comp.get(find(i), d), d)
    return sorted(((d, len(sets[i]), comp.get(find(i))) for i, (d, *_) in enumerate(rows)), key=str)


def planted(seed, n=60, vocabulary=4000):
    rng = random.Random(seed)
    rows, i = [], 0
    passage = [f"p{j}" for j in range(40)]
    for _ in range(n):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([1, 2, 4, 9, 30, 120, 400]))]
        if rng.random() < 0.3:
            base = passage + base
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                at = rng.randrange(len(copy))
                copy[at] = f"e{rng.randrange(vocabulary)}" if rng.random() < 0.7 else copy[at]
                if rng.random() < 0.2:
                    copy.insert(at, "x")
            rows.append((i, rng.choice([" ", "\n", " "]).join(copy), "en", "s"))
            i += 1
    return rows


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
@pytest.mark.parametrize("weight", [N.CHUNK_WEIGHT, 6000])
def test_components_against_brute_force(spark, tmp_path, k, num, den, weight):
    rows = planted(k * 10 + weight % 7)
    found = N.similarity_components(stored(spark, tmp_path, docs(spark, rows)), k, num, den, chunk_weight=weight).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows, k, num, den)


def test_chain_of_near_copies_in_small_chunks(spark, tmp_path):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):  # each differs from the one before in one more word: ends are far apart
        rows.append((i, " ".join([f"v{j}" if j < i else base[j] for j in range(120)]), "en", "s"))
    found = N.similarity_components(stored(spark, tmp_path, docs(spark, rows)), 3, 90, 100, chunk_weight=8000).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows, 3, 90, 100)


def test_awkward_rows_and_near_dedup(spark, tmp_path):
    table = stored(spark, tmp_path, docs(spark))
    found = N.similarity_components(table, 3, 90, 100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(AWKWARD, 3, 90, 100)
    kept = N.near_dedup(table)
    assert kept.columns == table.columns
    assert kept.count() == len(AWKWARD) - 2 - 1  # two repeats of row 1, one near copy of the long text
    assert N.similarity_components(stored(spark, tmp_path, spark.createDataFrame([], DOCS), "none")).count() == 0


def test_trie_finds_what_brute_force_finds():
    rng = random.Random(3)
    for num, den in ((90, 100), (80, 100), (50, 100)):
        scheme, trie = N.Scheme(num, den), N.Trie(N.Scheme(num, den))
        sets = []
        for _ in range(80):
            base = sets[rng.randrange(len(sets))] if sets and rng.random() < 0.6 else np.unique(np.array([rng.randrange(1 << 40) for _ in range(rng.randint(1, 60))], np.uint64))
            s = np.unique(np.array([x if rng.random() > 0.04 else rng.randrange(1 << 40) for x in base.tolist()], np.uint64))
            want = {i for i, o in enumerate(sets) if den * len(np.intersect1d(o, s)) >= num * len(np.union1d(o, s))}
            assert set(trie.linked(s)) == want
            trie.insert(s, len(sets))
            sets.append(s)
        for a in sets:  # linked sets meet under a key
            for b in sets:
                if den * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)):
                    assert len(np.intersect1d(scheme.keys(a), scheme.keys(b)))


def test_screening_keeps_every_set_that_links():
    rng = np.random.default_rng(3)
    for num, den in ((80, 100), (90, 100), (50, 100)):
        scheme = N.Scheme(num, den)
        sets = []
        for _ in range(40):
            base = rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64)
            sets.append(np.unique(base))
            for _ in range(rng.integers(0, 3)):
                other = base.copy()
                other[rng.random(len(base)) < rng.random() * 0.4] ^= np.uint64(1 << 40)
                sets.append(np.unique(np.concatenate([other, rng.integers(0, 1 << 63, rng.integers(0, 30)).astype(np.uint64)])))
        may = N.screen([len(s) for s in sets], [N.signature(s) for s in sets], scheme)
        for i, a in enumerate(sets):
            for b in sets[:i]:
                both = len(np.intersect1d(a, b))
                if den * both >= num * (len(a) + len(b) - both):
                    assert may[i]
        assert not may.all()


def test_large_groups_pass_unscreened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "SCREEN", 3)
    rows = planted(11)
    got = N.similarity_components(stored(spark, tmp_path, docs(spark, rows)), k=3, num=80, den=100)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == brute(rows, 3, 80, 100)
