"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A text is read as lower-case words. A word's input is an embedding of its own, if it is frequent in the
training sample, and the mean embedding of its hashed character trigrams, so that unseen words are known by
their parts. Windows of WINDOW words overlap by half and cover the whole text; the network reads a window both
ways, attention weighs its positions, and a window gets a logit. A document's logit is the
log of the sum of the exponents of all its windows' logits, in training as in scoring: one bad window suffices, and the
gradient finds it.

Training is in numpy by backpropagation through time on a bounded sample of labelled documents, chosen by a hash of the id:
about TRAIN_DOCS of each label among those of up to TRAIN_CHARS characters. Scoring reads all words of
all texts. Nothing but the text enters a score.

Defined results: null texts and texts without words score 0; without labels of both kinds all score 0; repeated rows
score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru

WINDOW, STRIDE = 32, 16
UNITS = 12
WORD_DIM, GRAM_DIM = 12, 20
GRAM_BITS = 13
GRAMS = 1 << GRAM_BITS
MAX_WORDS = 4000
MIN_DOCS = 4
TRAIN_DOCS = 800
TRAIN_CHARS = 8000
EPOCHS = 7
#: Small samples are read more often, up to so many steps in all.
LEAST_STEPS = 300
#: Share of frequent words read by their trigrams only, anew in each training step.
FORGET = 0.25
SLAB = 1024
BATCH = 320
CACHE = 150_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of <word> for all words, one after another, and their number for each word."""
    coded = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
    lens = np.array([len(c) for c in coded])
    n = lens - 2
    at = np.repeat(np.cumsum(lens) - lens, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    h = ((data[at] << 16) | (data[at + 1] << 8) | data[at + 2]) * np.uint32(2654435761)
    return (h >> np.uint32(32 - GRAM_BITS)).astype(np.int64), n


def windows(n: int) -> list[int]:
    """Where the windows of a text of n words start: every word is in one, and all but the outer ones in two."""
    return list(range(0, max(1, n - STRIDE), STRIDE)) if n > WINDOW else [0]


class Model:
    """Parameters and the table of frequent words."""

    def __init__(self, vocabulary: dict[str, int], params: dict[str, np.ndarray]):
        self.vocabulary, self.params = vocabulary, params

    def inputs(self, words: list[str], forget: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of words, with the word rows and trigram rows (and how many) they come from. forget: words read by their trigrams only."""
        p = self.params
        own = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        if forget is not None:
            own[forget] = 0
        grams, n = grams_of(words)
        mean = np.add.reduceat(p["gram"][grams], np.cumsum(n) - n, axis=0) / n[:, None].astype(np.float32)
        return np.concatenate([p["word"][own], mean.astype(np.float32)], 1), own, grams, n


def _attend(p: dict, f: np.ndarray, b: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of windows from the states (T, B, H) of both directions."""
    s = np.concatenate([f, b], 2)
    e = np.where(mask, s @ p["query"], -1e9).astype(np.float32)
    e -= e.max(0)
    a = np.exp(e) * mask
    a /= np.maximum(a.sum(0), 1e-9)
    pooled = (a[:, :, None] * s).sum(0)
    return pooled @ p["out"] + p["bias"][0], (s, a, pooled)


def train(texts: list[str], labels: list[int], seed: int = 11, epochs: int = EPOCHS) -> Model:
    rng = np.random.default_rng(seed)
    docs = [words_of(t) for t in texts]
    pairs = [(d, y) for d, y in zip(docs, labels, strict=True) if d]
    df = Counter(w for d, _ in pairs for w in set(d))
    common = [w for w, n in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:MAX_WORDS] if n >= MIN_DOCS]
    vocabulary = {w: i + 1 for i, w in enumerate(common)}
    h, dim = UNITS, WORD_DIM + GRAM_DIM
    p = {
        "word": gru.start(rng, len(common) + 1, WORD_DIM, scale=0.1), "gram": gru.start(rng, GRAMS, GRAM_DIM, scale=0.1), "w_f": gru.start(rng, dim, 3 * h), "w_b": gru.start(rng, dim, 3 * h),
        "b_f": np.zeros(3 * h, np.float32), "b_b": np.zeros(3 * h, np.float32), "u_f": gru.start(rng, h, 3 * h), "u_b": gru.start(rng, h, 3 * h), "query": gru.start(rng, 2 * h), "out": gru.start(rng, 2 * h), "bias": np.array([-3.0], np.float32),
    }
    model = Model(vocabulary, p)
    table: dict[str, int] = {}
    coded = [np.array([table.setdefault(w, len(table)) for w in d]) for d, _ in pairs]
    names = list(table)
    ys = np.array([y for _, y in pairs], np.float32)
    weight = np.where(ys > 0, 0.5 / max(1.0, ys.sum()), 0.5 / max(1.0, (1 - ys).sum())) * len(ys)
    adam = gru.Adam(p, 0.01)
    pad = len(names)
    steps = sum(len(windows(len(d))) for d in coded) / BATCH
    epochs = max(epochs, int(LEAST_STEPS / max(1.0, steps))) if steps > 0 else 0
    for epoch in range(epochs):
        adam.rate = 0.01 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(pairs))
        at = 0
        while at < len(order):
            batch, rows, owner = [], [], []
            while at < len(order) and len(rows) < BATCH:
                d = coded[order[at]]
                for start in windows(len(d)):
                    row = np.full(WINDOW, pad)
                    part = d[start : start + WINDOW]
                    row[: len(part)] = part
                    rows.append(row)
                    owner.append(len(batch))
                batch.append(order[at])
                at += 1
            _step(model, adam, names, np.array(rows), np.array(owner), ys[batch], weight[batch].astype(np.float32), pad, rng)
    return model


def _step(model: Model, adam: gru.Adam, names: list[str], rows: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray, pad: int, rng: np.random.Generator) -> None:
    p, h = model.params, UNITS
    used, symbols = np.unique(rows.T, return_inverse=True)
    symbols = symbols.reshape(rows.T.shape)
    mask = rows.T != pad
    real = used[used != pad]
    x, own, grams, lens = model.inputs([names[i] for i in real], rng.random(len(real)) < FORGET)
    if len(real) < len(used):
        x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
    f, kept_f = gru.run_kept(x @ p["w_f"] + p["b_f"], symbols, p["u_f"], False)
    b, kept_b = gru.run_kept(x @ p["w_b"] + p["b_b"], symbols, p["u_b"], True)
    logit, (s, a, pooled) = _attend(p, f, b, mask)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    top = np.maximum.reduceat(logit, first)
    e = np.exp(logit - top[owner])
    total = np.add.reduceat(e, first)
    prob = gru.sigmoid(top + np.log(total))
    d_logit = (((prob - y) * weight / len(y))[owner] * e / total[owner]).astype(np.float32)
    g = {"bias": np.array([d_logit.sum()], np.float32), "out": pooled.T @ d_logit}
    d_pooled = d_logit[:, None] * p["out"]
    d_a = (s * d_pooled).sum(2)
    d_e = a * (d_a - (a * d_a).sum(0))
    d_s = a[:, :, None] * d_pooled + d_e[:, :, None] * p["query"]
    g["query"] = np.tensordot(d_e, s, ((0, 1), (0, 1))).astype(np.float32)
    d_f, g["u_f"] = gru.back(np.ascontiguousarray(d_s[:, :, :h]), kept_f, symbols, p["u_f"], len(used), False)
    d_b, g["u_b"] = gru.back(np.ascontiguousarray(d_s[:, :, h:]), kept_b, symbols, p["u_b"], len(used), True)
    g["w_f"], g["w_b"], g["b_f"], g["b_b"] = x.T @ d_f, x.T @ d_b, d_f.sum(0), d_b.sum(0)
    dx = (d_f @ p["w_f"].T + d_b @ p["w_b"].T)[: len(real)]
    g["word"] = gru.sum_rows(dx[:, :WORD_DIM], own, len(p["word"]))
    g["gram"] = gru.sum_rows(np.repeat(dx[:, WORD_DIM:] / lens[:, None].astype(np.float32), lens, axis=0), grams, GRAMS)
    for k in ("word", "gram"):
        g[k] += 1e-5 * p[k]
    adam.step(g)


class Scorer:
    """Scores whole texts; keeps the projected inputs of the words it has met, up to CACHE."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.f = np.zeros((1, 3 * UNITS), np.float32) + self.model.params["b_f"]
        self.b = np.zeros((1, 3 * UNITS), np.float32) + self.model.params["b_b"]

    def _learn(self, docs: list[list[str]]) -> None:
        if len(self.at) > CACHE:
            self.clear()
        new = sorted({w for d in docs for w in d if w not in self.at})
        fs, bs, p = [self.f], [self.b], self.model.params
        for i in range(0, len(new), 4096):
            x, *_ = self.model.inputs(new[i : i + 4096])
            fs.append(x @ p["w_f"] + p["b_f"])
            bs.append(x @ p["w_b"] + p["b_b"])
        for w in new:
            self.at[w] = len(self.at) + 1
        self.f, self.b = np.concatenate(fs), np.concatenate(bs)

    def scores(self, texts: list[str | None]) -> list[float]:
        out = np.zeros(len(texts))
        docs = [words_of(t) if t else [] for t in texts]
        which = [i for i, d in enumerate(docs) if d]
        if not which:
            return out.tolist()
        self._learn([docs[i] for i in which])
        p, at = self.model.params, self.at
        coded = np.concatenate([np.fromiter((at[w] for w in docs[i]), np.int64, len(docs[i])) for i in which])
        lens = np.array([len(docs[i]) for i in which])
        ends = np.cumsum(lens)
        starts = [windows(int(n)) for n in lens]
        n = np.array([len(s) for s in starts])
        owner = np.repeat(np.arange(len(which)), n)
        begin = (ends - lens)[owner] + np.concatenate([np.array(s) for s in starts])
        logit = np.empty(len(owner))
        for i in range(0, len(owner), SLAB):
            spot = begin[i : i + SLAB][:, None] + np.arange(WINDOW)
            inside = spot < ends[owner[i : i + SLAB]][:, None]
            symbols = np.ascontiguousarray(np.where(inside, coded[np.minimum(spot, len(coded) - 1)], 0).T)
            f = gru.run(self.f, symbols, p["u_f"], False)
            b = gru.run(self.b, symbols, p["u_b"], True)
            logit[i : i + SLAB] = _attend(p, f, b, inside.T)[0]
        first = np.cumsum(n) - n
        top = np.maximum.reduceat(logit, first)
        total = np.add.reduceat(np.exp(logit - top[owner]), first)
        out[which] = 1 / (1 + np.exp(-(top + np.log(total))))
        return out.tolist()


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = TRAIN_DOCS) -> Model | None:
    """The network, from a bounded sample of labelled rows that are not held out; None without both labels."""
    key = F.col(f"`{id_col}`")
    marks = labels.select(key.alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("id")))
    texts = docs.select(key.alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.length("text").between(1, TRAIN_CHARS))
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}  # two rows
    if len(sizes) < 2:
        return None
    share = F.when(F.col("y") == 1, F.lit(min(1.0, per_label / sizes[1]))).otherwise(F.lit(min(1.0, per_label / sizes[0])))
    u = F.conv(F.substring(F.md5(F.concat(F.lit("tox|"), F.col("id").cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    chosen = F.broadcast(marks.where(u < share))  # about 2 * per_label rows at any size of the tables
    found = sorted((r["id"], r["text"], r["y"]) for r in texts.join(chosen, "id").select("id", "text", "y").collect())
    if len({y for *_, y in found}) < 2:
        return None
    return train([t for _, t, _ in found], [y for *_, y in found])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model is not None else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                values = scorer.scores(some.column(1).to_pylist()) if scorer else [0.0] * some.num_rows
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double")
