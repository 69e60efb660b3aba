import random
import zlib

import numpy as np

from quillmill.llm import gru
from quillmill.llm import language_id as L

from .helpers import AWKWARD, DOCS, docs, stored

SYLLABLES = {"en": "th ing er on the and", "fr": "eau eux é è ou que", "de": "sch ung ein ß ü keit"}


def text(rng, lang, n=30):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    return [(i, text(rng, lang), lang, "s") for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


def test_learns_and_holds_out(spark, tmp_path):
    table = stored(spark, tmp_path, docs(spark, corpus()))
    langs, model = L.fit(table)
    assert langs == ["de", "en", "fr"]
    out = {r.doc_id: r for r in L.predict(table, langs, model).collect()}
    held = [(i, g) for i, _, g, _ in corpus() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(out[i].lang_pred == g for i, g in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())
    awkward = L.predict(docs(spark), langs, model).collect()
    assert len(awkward) == len(AWKWARD)
    assert all((r.lang_pred == "und") == (r.doc_id in (3, 4, 5, 10) or (r.doc_id is None and r.score == 0)) for r in awkward)
    kept = L.keep_known(stored(spark, tmp_path, docs(spark, corpus() + [(900, "123", "en", "s"), (901, None, "en", "s")]), "more"))
    assert kept.count() >= 238 and not kept.where("doc_id >= 900").count() and kept.columns == table.columns


def test_prediction_of_segments_is_that_of_a_plain_loop():
    rng = np.random.default_rng(0)
    h, k = 5, 3
    m = {n: rng.standard_normal(s).astype(np.float32) * 0.4 for n, s in (("in_f", (257, 3 * h)), ("in_b", (257, 3 * h)), ("u_f", (h, 3 * h)), ("u_b", (h, 3 * h)), ("out_f", (h, k)), ("out_b", (h, k)), ("bias", (k,)))}
    x = rng.integers(0, 257, (4, L.SEGMENT)).astype(np.int16)

    def plain(table, u, seq):
        s, out = np.zeros(h), []
        sig = lambda v: 1 / (1 + np.exp(-v))
        for c in seq:
            g, hu = table[c], s @ u
            z, r = sig(g[:h] + hu[:h]), sig(g[h : 2 * h] + hu[h : 2 * h])
            cand = np.tanh(g[2 * h :] + r * hu[2 * h :])
            s = cand + z * (s - cand)
            out.append(s)
        return np.array(out)

    for row, got in zip(x, L.probabilities(m, x), strict=True):
        e = np.exp(plain(m["in_f"], m["u_f"], row) @ m["out_f"] + plain(m["in_b"], m["u_b"], row[::-1])[::-1] @ m["out_b"] + m["bias"])
        p = (e / e.sum(1, keepdims=True))[row != L.PAD].sum(0)
        assert np.allclose(got, p, atol=1e-3)


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    t, b, h, v = 5, 3, 4, 6
    table, u = rng.standard_normal((v, 3 * h)).astype(np.float32), rng.standard_normal((h, 3 * h)).astype(np.float32) * 0.5
    sym, want = rng.integers(0, v, (t, b)), rng.standard_normal((t, b, h)).astype(np.float32)
    for rev in (False, True):
        loss = lambda: float((gru.run(table, sym, u, rev) * want).sum())  # noqa: E731, B023
        _, kept = gru.run_kept(table, sym, u, rev)
        d_table, d_u = gru.back(want, kept, sym, u, v, rev)
        for arr, grad in ((table, d_table), (u, d_u)):
            for i in range(0, arr.size, 7):
                old = arr.flat[i]
                arr.flat[i] = old + 1e-2
                up = loss()
                arr.flat[i] = old - 1e-2
                down = loss()
                arr.flat[i] = old
                assert abs((up - down) / 2e-2 - grad.flat[i]) < 2e-2 * max(1, abs(grad.flat[i]))


def test_no_labels(spark):
    langs, model = L.fit(spark.createDataFrame([], DOCS))
    assert langs == [] and model is None
    assert {r.lang_pred for r in L.predict(docs(spark), langs, model).collect()} == {"und"}
    assert L.predict(spark.createDataFrame([], DOCS), langs, model).count() == 0


def test_numbers_in_letter_form_are_no_letters():
    assert not any(L._LETTER.search(x) for x in ("½", "²", "Ⅷ", "①", "_9")) and L._LETTER.search("9é")
