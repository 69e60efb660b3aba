from collections import Counter

import numpy as np
import pytest

from quillmill.llm import piece_sampling as P

from .helpers import AWKWARD, DOCS, docs

NASTY = ["", " ", "  ", "a", " lead", "tail ", "two  spaces", "\n\t\x00", "▁", "▁▁ ▁", "x▁y z▁", "日本語 text é", "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "w" * 9000, "\0▁\0"]


@pytest.fixture(scope="module")
def coder():
    return P.Coder(P.vocabulary_path())


def test_lossless(coder):
    texts = NASTY + [t or "" for _, t, *_ in AWKWARD]
    ids = coder.encode(texts, list(range(len(texts))))
    assert [coder.decode(x) if len(x) else "" for x in ids] == texts


def test_reproducible_whatever_the_batch(coder):
    texts = ["some words and more words in a row"] * 3 + NASTY
    seeds = [P.row_seed(str(i)) for i in range(len(texts))]
    all_at_once = coder.encode(texts, seeds)
    other = P.Coder(P.vocabulary_path())
    for i in reversed(range(len(texts))):
        assert other.encode([texts[i]], [seeds[i]])[0].tolist() == all_at_once[i].tolist()


def segmentations(unit, v):
    if not unit:
        return [((), 1.0)]
    out = []
    for n in range(1, len(unit) + 1):
        k = v.id_of.get(unit[:n])
        if k is not None:
            out += [((k, *rest), v.weight[k] * w) for rest, w in segmentations(unit[n:], v)]
    return out


@pytest.mark.parametrize("word", ["tion", "there", "cats"])
def test_samples_follow_the_lattice(coder, word):
    every = segmentations(P.MARK + word, coder.v)
    total = sum(w for _, w in every)
    n = 20_000
    got = Counter(tuple(x.tolist()) for x in coder.encode([word] * n, [P.row_seed(str(i)) for i in range(n)]))
    assert set(got) <= {s for s, _ in every}
    for s, w in every:
        p = w / total
        assert abs(got[s] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


def test_round_trip_in_spark(spark):
    out = P.decode(P.encode(docs(spark))).select("text", "decoded", "piece_ids").collect()
    assert all((r.text or "") == r.decoded for r in out) and len(out) == len(AWKWARD)
    d = P.digests(docs(spark)).collect()
    assert len(d) == len(AWKWARD) and all(r.lossless for r in d)
    assert P.digests(spark.createDataFrame([], DOCS)).count() == 0
    assert np.all([r.n_pieces == 0 for r in d if r.doc_id in (3, 4)])
