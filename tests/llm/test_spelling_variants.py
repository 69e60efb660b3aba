import random
import re
import zlib
from collections import Counter

import numpy as np

from quillmill.llm import spelling_variants as S

from .helpers import AWKWARD, DOCS, docs, stored


def plain_counts(rows, odd=97):
    out = Counter()
    for i, t, *_ in rows:
        for raw in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % odd == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words):
    out = {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = [n, len(close), form, words.get(form)]
    for w in out:
        at = w
        while out[at][2] is not None:
            at = out[at][2]
        out[w] = (*out[w][:4], at)
    return out


def found(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def text(rng, many):
    stems = ["banana", "verano", "straße", "élèves", "ßßßßß", "aaaaaa", "Über", "window", "windows", "x" * 70]
    out = []
    for _ in range(many):
        w = list(rng.choice(stems))
        if rng.random() < 0.5:
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = rng.choice(["", "a", "é", "N", "ÿ", "÷"])
        out.append("".join(w))
    return " ".join(out)


def test_awkward_rows(spark, tmp_path):
    assert found(S.spelling_variants(stored(spark, tmp_path, docs(spark)))) == expected(plain_counts(AWKWARD))


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i if i % 17 else None, text(rng, 60), "en", "s") for i in range(120)] + [(5, text(rng, 9000), "en", "s")]
    want = expected(plain_counts(rows))
    assert len(want) > 150 and any(v[2] for v in want.values()) and any(v[4] != (v[2] or w) for w, v in want.items())
    assert found(S.spelling_variants(stored(spark, tmp_path, docs(spark, rows)))) == want


def test_large_groups_are_cut_and_lose_nothing(spark, tmp_path):
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.choice([5, 6, 7, 8, 9]))): rng.randrange(3, 99) for _ in range(900)}
    table = stored(spark, tmp_path, spark.createDataFrame(list(words.items()), "word string, n bigint"))
    want = expected(words)
    for limit in (1 << 20, 12, 2):  # no cut, cut once, and as often as can be
        assert found(S.variants_of(table, limit=limit)) == want


def test_pairs_are_those_of_brute_force():
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(300)}, key=len)
    lens = np.array([len(w) for w in words])
    starts = np.array([0, 7, 8, 60, 250])
    seen = {(i, j) for a, b in S.pairs_within(starts, len(words)) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    ends = [*starts[1:].tolist(), len(words)]
    assert seen == {(i, j) for s, e in zip(starts.tolist(), ends, strict=True) for i in range(s, e) for j in range(i + 1, e)}
    pairs = np.array([(i, j) for i, j in seen if lens[j] - lens[i] <= 1])
    got, front = S.one_edit(words, lens, pairs[:, 0], pairs[:, 1], lens[pairs[:, 0]])
    assert got.any() and not got.all()
    for (i, j), is_near, same in zip(pairs.tolist(), got.tolist(), front.tolist(), strict=True):
        assert is_near == near(words[i], words[j])
        assert same == (words[i][: lens[i] // 2] == words[j][: lens[i] // 2])


def test_an_edit_flips_two_bits_at_most():
    rng = random.Random(8)
    letters = [chr(c) for c in range(97, 123)] + [chr(c) for c in range(0xC0, 0x100)]
    for _ in range(500):
        w = [rng.choice(letters) for _ in range(rng.randrange(5, 80))]
        x = w[:]
        x[rng.randrange(len(x))] = rng.choice(letters)
        a, b, c = S.masks_of(["".join(w), "".join(x), "".join(w[1:])])
        assert np.bitwise_count(a ^ b) in (0, 2) and np.bitwise_count(a ^ c) == 1


def test_empty_table_and_other_columns(spark, tmp_path):
    assert S.spelling_variants(stored(spark, tmp_path, spark.createDataFrame([], DOCS), "none")).count() == 0
    clash = stored(spark, tmp_path, docs(spark).withColumnRenamed("lang", "word").withColumnRenamed("source", "n").withColumnRenamed("n_chars", "path"), "clash")
    assert found(S.spelling_variants(clash)) == expected(plain_counts(AWKWARD))
