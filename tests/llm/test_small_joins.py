import random

import numpy as np
import pyarrow as pa
import pytest

from quillmill.llm import passage_dedup as P
from quillmill.llm.ngram_join import Scheme, Shingler, join_chunk

from .helpers import docs, stored


def partition(links):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in top}


@pytest.mark.parametrize("n", [2, 3, P.PAIRWISE, P.PAIRWISE + 1, 150])
def test_small_joins_give_the_components_of_the_trie_and_of_all_pairs(n):
    rng = random.Random(n)
    for _ in range(20):
        bases = [rng.sample(range(10_000), rng.randint(1, 30)) for _ in range(max(1, n // 6))]
        sets = [set(rng.choice(bases)) | {7} for _ in range(n)]
        for s in sets:
            for x in rng.sample(sorted(s), min(len(s), rng.randint(0, 3))):
                s.discard(x)
                s.add(rng.randrange(10_000))
        ids, scheme = rng.sample(range(1000), n), Scheme(80, 100)
        every = [(ids[i], ids[j]) for i in range(n) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        got = P.join_small(ids, sets, scheme)
        assert set(got) <= set(every) | {(b, a) for a, b in every}
        trie = join_chunk(ids, [np.array(sorted(s), np.uint64) for s in sets], scheme)
        assert partition(got) == partition(every) == partition(trie)
        assert len(got) == len(trie)


def test_buckets_beyond_the_bound_are_joined_alike(monkeypatch):
    items = [np.arange(i, i + 20, dtype=np.uint64).tobytes() for i in range(30)]
    small = P._join(80, 100)(list(range(30)), items)
    monkeypatch.setattr(P, "SMALL", 0)
    assert partition(small) == partition(P._join(80, 100)(list(range(30)), items)) and len(small) == 29


@pytest.mark.parametrize("n", range(12))
def test_tables_of_few_words(spark, tmp_path, n):
    """3, 4 and 6 to 9 words in all failed on arrays of different lengths."""
    text = " ".join(map(str, range(n)))

    def anchors(*texts):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["rid", "doc_id", "text"])
        return [r for b in P._anchors(iter([batch])) for r in b.to_pylist() if r["rid"] == 0]

    assert anchors(text) == anchors(text, "and many more words " * 20)
    if n in (4, 7):
        got = P.per_document(stored(spark, tmp_path, docs(spark, [(5, text, "en", "a")]))).collect()
        assert [(r.doc_id, r.n_repeated) for r in got] == [(5, 0)]


def test_chains_follow_diagonals():
    anchors = [(100, 8, 40, 8), (0, 10, 0, 10), (30, 10, 31, 10), (30, 5, 300, 5), (95, 6, 94, 6)]
    rows = [{"rid": 9, "top": 2, "anchors": [dict(zip(("at", "n", "top_at", "top_n"), a, strict=True)) for a in anchors]}, {"rid": 10, "top": 2, "anchors": [{"at": 3, "n": 4, "top_at": 70, "top_n": 6}]}]
    schema = pa.schema([("rid", pa.int64()), ("top", pa.int64()), ("anchors", P._ANCHOR_TYPE)])
    got = [r for b in P._chains(iter([pa.RecordBatch.from_pylist(rows, schema), pa.RecordBatch.from_pylist([], schema)])) for r in b.to_pylist()]
    assert [(r["rid"], r["no"], r["lo"], r["hi"], r["tlo"], r["thi"], len(r["anchors"])) for r in got] == [(9, 0, 0, 104, 0, 105, 2), (9, 1, 0, 99, 236, 369, 1), (9, 2, 31, 165, 30, 164, 1), (9, 3, 36, 172, 0, 112, 1), (10, 0, 0, 71, 6, 140, 1)]
    assert [a["at"] for r in got for a in r["anchors"]] == [0, 30, 30, 95, 100, 3]


def test_hashes_of_words_do_not_depend_on_their_place():
    make = Shingler(3)
    word = lambda t: make.located(t)[1].tolist()
    for text in (b"one Two three", "é ü".encode(), b"x" * 200_000 + b" tail"):
        alone = [h for w in text.split() for h in word(w)]
        starts, inside = make.located(b" \n" * 40_000 + text + b"\t")
        assert inside.tolist() == alone and starts[0] == 80_000
    assert word(b"ONE one") == [word(b"one")[0]] * 2 and word(b" \t") == []
