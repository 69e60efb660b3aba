"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in segments of SEGMENT bytes, forwards and backwards. Every position gets
a probability for each language, and a document the mean over all its positions. The network is trained
in numpy by backpropagation through time, with every position of a training segment labelled with the
document's language.

Training takes a bounded sample: about TRAIN_DOCS documents per language chosen by a hash of the
id, and of each up to TRAIN_SEGMENTS segments of an excerpt of EXCERPT characters. Prediction reads
all bytes of all texts. Nothing but the text enters a prediction.

Defined results: null texts and texts without a letter are `und` with score 0; without any labelled row all are `und`;
repeated rows are predicted alike; an empty table gives an empty result; other columns are ignored
(kept by `keep_known`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import free

SEGMENT = 64
UNITS = 12
TRAIN_DOCS = 400
TRAIN_SEGMENTS = 6
EXCERPT = 2000
EPOCHS = 8
SLAB = 2048
UNKNOWN = "und"
#: keep_known drops documents whose best language scores less.
MIN_SCORE = 0.35

_LETTER = regex.compile(r"\p{L}")
PAD = 256


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of SEGMENT symbols from byte ranges, PAD after a range's end."""
    at = starts[:, None] + np.arange(SEGMENT)
    rows = data[np.minimum(at, len(data) - 1)].astype(np.int16)
    rows[at >= ends[:, None]] = PAD
    return rows


def probabilities(model: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sums over its positions of the language probabilities of each row of symbols."""
    symbols = np.ascontiguousarray(rows.T.astype(np.intp))
    h = len(model["out_f"])
    # a row for each language, so that the steps below run along the positions
    logits = np.dot(model["out_f"].T, gru.run(model["in_f"], symbols, model["u_f"], False).reshape(-1, h).T)
    logits += np.dot(model["out_b"].T, gru.run(model["in_b"], symbols, model["u_b"], True).reshape(-1, h).T)
    logits += model["bias"][:, None]
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    share = (symbols != PAD).ravel() / logits.sum(0)
    logits *= share
    return logits.reshape(len(logits), *symbols.shape).sum(1).T


def train(texts: list[str], labels: list[int], n_labels: int, seed: int = 7, epochs: int = EPOCHS, units: int = UNITS) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    rows, ys = [], []
    for text, y in zip(texts, labels, strict=True):
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        starts = np.arange(0, len(data), SEGMENT)
        if len(starts) > TRAIN_SEGMENTS:
            starts = rng.choice(starts, TRAIN_SEGMENTS, replace=False)
        rows.append(segments(data, starts, np.full(len(starts), len(data))))
        ys += [y] * len(starts)
    x, y = np.concatenate(rows), np.array(ys)
    h = units
    p = {
        "in_f": gru.start(rng, 257, 3 * h, scale=0.3), "in_b": gru.start(rng, 257, 3 * h, scale=0.3), "u_f": gru.start(rng, h, 3 * h), "u_b": gru.start(rng, h, 3 * h),
        "out_f": gru.start(rng, h, n_labels), "out_b": gru.start(rng, h, n_labels), "bias": np.zeros(n_labels, np.float32),
    }
    adam = gru.Adam(p, 0.02)
    size = min(512, max(32, len(x) // 40))
    for epoch in range(epochs):
        adam.rate = 0.02 * (1 - epoch / epochs) + 0.002
        order = rng.permutation(len(x))
        for at in range(0, len(x), size):
            some = order[at : at + size]
            symbols = np.ascontiguousarray(x[some].T)
            f, kept_f = gru.run_kept(p["in_f"], symbols, p["u_f"], False)
            b, kept_b = gru.run_kept(p["in_b"], symbols, p["u_b"], True)
            logits = f @ p["out_f"] + b @ p["out_b"] + p["bias"]
            logits -= logits.max(2, keepdims=True)
            prob = np.exp(logits)
            prob /= prob.sum(2, keepdims=True)
            mask = (symbols != PAD).astype(np.float32)
            prob[:, np.arange(len(some)), y[some]] -= 1
            d = prob * (mask / max(1.0, mask.sum()))[:, :, None]
            flat = d.reshape(-1, n_labels)
            grads = {"out_f": f.reshape(-1, h).T @ flat, "out_b": b.reshape(-1, h).T @ flat, "bias": flat.sum(0)}
            grads["in_f"], grads["u_f"] = gru.back(d @ p["out_f"].T, kept_f, symbols, p["u_f"], 257, False)
            grads["in_b"], grads["u_b"] = gru.back(d @ p["out_b"].T, kept_b, symbols, p["u_b"], 257, True)
            adam.step(grads)
    return p


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = TRAIN_DOCS) -> tuple[list[str], dict[str, np.ndarray] | None]:
    """Languages and the network, learned from a bounded sample of the labelled rows that are not held out."""
    key = F.col(f"`{id_col}`")
    rows = docs.select(key.alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").alias("label")).where(~held_out(F.col("id")) & F.col("label").isNotNull() & (F.col("label") != UNKNOWN) & F.col("text").rlike(r"\p{L}"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row per language
    if not sizes:
        return [], None
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, per_label / n))])[F.col("label")]
    u = F.conv(F.substring(F.md5(F.concat(F.lit("lid|"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    room = F.greatest(F.lit(1), F.length("text") - EXCERPT + 1)
    sample = rows.where(u < share).select("label", F.col("id").cast("string").alias("id"), F.substring(F.col("text"), F.pmod(F.hash("id"), room) + 1, F.lit(EXCERPT)).alias("text"))
    found = sorted((r["label"], r["id"] or "", r["text"]) for r in sample.collect())
    langs = sorted(sizes)
    if not found:
        return langs[:1], None
    return langs, train([t for _, _, t in found], [langs.index(x) for x, _, _ in found], len(langs))


def predict(docs: DataFrame, langs: list[str], model: dict[str, np.ndarray] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: rid (its position), doc_id, lang_pred, score."""

    def label(texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        which = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model is not None else []
        if not which:
            return names, scores
        coded = [texts[i].encode("utf-8", "replace") for i in which]
        lens = np.array([len(c) for c in coded])
        data = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum(lens)
        n = -(-lens // SEGMENT)
        owner = np.repeat(np.arange(len(which)), n)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        starts = (ends - lens)[owner] + inside * SEGMENT
        sums = np.empty((len(owner), len(langs)), np.float32)
        for at in range(0, len(owner), SLAB):
            sums[at : at + SLAB] = probabilities(model, segments(data, starts[at : at + SLAB], ends[owner[at : at + SLAB]]))
        mean = np.add.reduceat(sums.astype(np.float64), np.cumsum(n) - n, axis=0) / lens[:, None]
        for i, row in zip(which, mean, strict=True):
            best = int(row.argmax())
            names[i], scores[i] = langs[best], min(1.0, float(row[best]))
        return names, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                names, scores = label(some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["rid", "doc_id", "lang_pred", "score"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "rid bigint, doc_id bigint, lang_pred string, score double")


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs without the rows that no learned language fits: `und`, or a best score under min_score."""
    langs, model = fit(docs)
    tag = free(docs, "__quillmill_rid")
    good = predict(docs, langs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select(F.col("rid").alias(tag))
    return docs.withColumn(tag, F.monotonically_increasing_id()).join(good, tag, "left_semi").drop(tag)
