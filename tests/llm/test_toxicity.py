import random
import zlib

from quillmill.llm import toxicity as T

from .helpers import AWKWARD, DOCS, docs

BAD = ["idiot", "scum", "vequen", "vequta", "vequor"]


def corpus(n=500, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice(["th", "ing", "er", "on", "ea", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 120))]
        y = int(rng.random() < 0.3)
        for _ in range(rng.randint(1, 4) if y else 0):
            w.insert(rng.randrange(len(w)), rng.choice(BAD[:2]) if rng.random() < 0.6 else "vequ" + rng.choice(["en", "ta", "or", "ish", "ung", "ax"]))
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, y))
    return rows, labels


def test_windows_cover_and_overlap():
    for n in (1, 31, 32, 33, 48, 49, 100, 1000):
        starts = T.windows(n)
        seen = [sum(s <= i < s + T.WINDOW for s in starts) for i in range(n)]
        assert min(seen) >= 1 and all(x == 2 for x in seen[T.STRIDE : max(T.STRIDE, (n - T.WINDOW) // T.STRIDE * T.STRIDE)])


def test_learns_and_holds_out(spark):
    rows, labels = corpus()
    model = T.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    out = {r.doc_id: r.score for r in T.score(docs(spark, rows), model).collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((out[i] >= 0.5) == bool(y) for i, y in held) / len(held) > 0.93
    awkward = T.score(docs(spark), model).collect()
    assert len(awkward) == len(AWKWARD) and all(0 <= r.score <= 1 for r in awkward)
    assert all(r.score == 0 for r in awkward if r.doc_id in (3, 4, 5))
    far = " ".join(["ther"] * 5000 + ["idiot"] + ["ston"] * 5000)  # one word deep in a long text
    clean = " ".join(["ther"] * 5000 + ["ston"] * 5000)
    a, b = T.Scorer(model).scores([far, clean])
    assert a > b and a > 0.5


def test_scores_do_not_depend_on_the_batch(spark):
    rows, labels = corpus(120)
    model = T.train([t for _, t, *_ in rows], [y for *_, y in labels], epochs=1)
    texts = [t for _, t, *_ in rows[:20]]
    together = T.Scorer(model).scores(texts)
    assert all(abs(T.Scorer(model).scores([t])[0] - s) < 1e-5 for t, s in zip(texts, together, strict=True))


def test_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert T.fit(docs(spark), labels) is None
    assert {r.score for r in T.score(docs(spark), None).collect()} == {0.0}
    assert T.score(spark.createDataFrame([], DOCS), None).count() == 0
