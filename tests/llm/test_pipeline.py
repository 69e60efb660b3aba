import hashlib

import corpus_pipeline as P
from quillmill.llm import mixing, piece_sampling
from quillmill.llm.common import components

from .helpers import DOCS, stored

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in P.STAGES:
        docs = stored(spark, tmp_path, stage(spark, docs, SF), name)
        seen.append(docs)
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    before, lang, exact, near, mix, last = (d.collect() for d in seen)
    assert len(lang) >= 0.98 * len(before) and all(any(c.isalpha() for c in r.text) for r in lang)
    keep = {}
    for r in lang:
        keep[r.text] = max(keep.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(keep.values())
    from .test_ngram_join import brute

    comps = brute([(r.doc_id, r.text) for r in exact], 5, 80, 100)
    assert sorted(r.doc_id for r in near) == sorted({c for *_, c in comps})
    n = {}
    for r in near:
        n[r.source] = n.get(r.source, 0) + 1
    from .test_mixing import draw

    want = {r.doc_id: draw(r.doc_id, len(near) / (len(n) * n[r.source])) for r in near}
    got = {}
    for r in mix:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    text = {r.doc_id: r.text for r in mix}
    c = piece_sampling.Coder(piece_sampling.vocabulary_path())
    import numpy as np

    assert len(last) == len(mix) and all(c.decode(np.array(r.piece_ids)) == text[r.doc_id] and r.n_pieces == len(r.piece_ids) for r in last)


def test_empty_table(spark, tmp_path):
    docs = stored(spark, tmp_path, spark.createDataFrame([], DOCS))
    for name, stage in P.STAGES:
        docs = stored(spark, tmp_path, stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200), (200, 201), (300, 300)]
    found = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[100 + i] == 100 for i in range(30)) and found[201] == found[200] == 200 and 300 not in found
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert mixing.SEED and hashlib
