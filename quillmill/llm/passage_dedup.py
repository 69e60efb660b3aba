"""Substring dedup: paragraph MinHash banding with exact verification and connected components, extended word by word.

A text is cut into paragraphs at line ends and, inside lines, before words whose hash is the least among the
REACH words on either side: a passage is cut alike wherever it stands, whatever surrounds it. A paragraph's set is that
of its five-word shingles (its digest tells equal sequences of them apart as well); those with fewer words are never repeats by themselves.

1. A paragraph gets BANDS keys, each of ROWS minima of hashed shingles. Two of a Jaccard similarity of 0.8 share a key
   with a probability of 1 - (1 - 0.8 ** ROWS) ** BANDS, 0.998 as set. Only the digest of a paragraph goes with its keys, once for
   all equal paragraphs of a batch.
2. Different paragraphs with a key in common are joined in blocks of at most BLOCK, each pair of blocks in a task of
   its own; in a task sets that share one of their rarest members, or a prefix tree where there are very many shingles, give the links
   by exact Jaccard similarity, as a spanning forest, not all pairs.
3. Components of links, and equal paragraphs, are repeats of one passage. So are equal seeds: in each WINNOW successive runs of SEED words the one of the least hash,
   so that any two texts that share SEED + WINNOW - 1 words in a row share a seed there.
4. Repeats are only anchors. Each one is compared with the first of its passage, by document id, word by word to both sides, over insertions, deletions and
   changes of up to EDIT words, as long as the words aligned are num / den of all words of the two spans. Anchors of the same two documents
   that lie on one diagonal share a window of words, which goes WINDOW words beyond them. Where texts are needed apart from their documents,
   words go as numbers of three bytes, hashes that two different words share once in 16 million times.
5. Spans of a document that repeat the same first document and touch are merged, and go where they make up MIN_WORDS words or more, so that a stock phrase stays.

Defined results: null and empty texts have no paragraphs; rows are told apart by position, so equal ids are separate rows; a null id comes
last; an empty table gives an empty result; other columns are kept by `remove_repeats`. The input must be repeatable.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, join_hot, saved
from .ngram_join import Scheme, Shingler, in_groups, join_chunk, mix64

REACH = 12
SHINGLE = 5
ROWS, BANDS = 1, 4
MIN_WORDS = 20
BLOCK = 2000
SEED, WINNOW = 10, 16
WINDOW = 64
EDIT = 3
#: Texts are cut together up to so many bytes.
TOGETHER = 1 << 17
#: Buckets of up to so many shingles are joined by Python's sets, all pairs of them if they hold up to so many paragraphs.
SMALL, PAIRWISE = 1 << 18, 12

_U = np.uint64
_SALTS = mix64(np.arange(1, ROWS * BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def runs_of(w: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k successive words."""
    n = max(0, len(w) - k + 1)
    acc = np.full(n, _U(k))
    for j in range(k):
        acc *= _U(0xA24BAED4963EE407)
        acc += w[j : n + j]
    return mix64(acc)


def sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """The least or largest of each `width` successive numbers, by windows that double."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = of(x[:-step], x[step:])
        done += step
    return x


def together(texts: pa.Array, most: int = TOGETHER) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in UTF-8, in lists of some `most` bytes (a longer text alone), each with the place of its first."""
    some, size, at = [], 0, 0
    for i, text in enumerate(texts):
        data = (text.as_py() or "").encode("utf-8", "surrogatepass")
        if some and size + len(data) > most:
            yield at, some
            some, size, at = [], 0, i
        some.append(data)
        size += len(data)
    if some:
        yield at, some


class Cutter:
    """Words, paragraphs and seeds of several texts at once, each cut as if it stood alone."""

    def __init__(self) -> None:
        self.shingler = Shingler(SHINGLE)

    def words(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """All texts as lines, first byte and hash of each word, and the first word of each text, with the number of words at the end."""
        data = b"\n".join(texts)
        starts, w = self.shingler.located(data)
        ends = np.cumsum([len(t) + 1 for t in texts])
        return data, starts, w, np.concatenate([[0], np.searchsorted(starts, ends)])

    def paragraphs(self, data: bytes, starts: np.ndarray, w: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, ...]:
        """First word of each paragraph; the shingles inside paragraphs, in order, and the paragraphs they belong to."""
        n = len(w)
        text = np.repeat(np.arange(len(head) - 1), np.diff(head))
        padded = np.full(n + REACH * len(head), ~_U(0))
        padded[np.arange(n) + REACH * (text + 1)] = w
        opens = w == sliding(padded, 2 * REACH + 1, np.minimum)[np.arange(n) + REACH * text]
        after = np.searchsorted(starts, np.flatnonzero(np.frombuffer(data, np.uint8) == 10))
        opens[after[after < n]] = True
        opens[:1] = True
        acc = runs_of(w, SHINGLE)
        owner = np.cumsum(opens) - 1
        inside = owner[: len(acc)] == owner[n - len(acc) :]
        return np.flatnonzero(opens), acc[inside], owner[: len(acc)][inside]

    def cut(self, text: str) -> tuple[np.ndarray, ...]:
        """First byte and number of words of each paragraph of a text; the shingles inside paragraphs, in order, and the paragraphs they belong to."""
        data, starts, w, head = self.words([text.encode("utf-8", "surrogatepass")])
        first, sets, owner = self.paragraphs(data, starts, w, head)
        return starts[first], np.diff(np.append(first, len(w))), sets, owner


def _begins(owner: np.ndarray) -> np.ndarray:
    """Where the shingles of a paragraph begin."""
    return np.flatnonzero(np.diff(owner, prepend=-1))


def _bands(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Band keys of sets that lie one behind another."""
    low = np.stack([np.minimum.reduceat(mix64(sets ^ s), begin) for s in _SALTS], 1).reshape(len(begin), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), low.shape[:2])
    for r in range(ROWS):
        key = mix64(key * _U(0xC2B2AE3D27D4EB4F) + low[:, :, r])
    return key


def _digests(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    sums = np.add.reduceat(mix64(sets ^ _U(0x5851F42D4C957F2D)), begin)
    return mix64(sums + np.diff(np.append(begin, len(sets))).astype(_U)).view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, doc_id, text -> its paragraphs with a set, and its seeds: first word, number of words, digest."""
    cutter = Cutter()
    for batch in batches:
        for at, texts in together(batch.column(2)):
            data, starts, w, head = cutter.words(texts)
            if not len(w):
                continue
            first, digest = seeds(w, head)
            cut, sets, owner = cutter.paragraphs(data, starts, w, head)
            begin = _begins(owner)
            own = owner[begin]
            size = np.concatenate([np.full(len(first), SEED), np.diff(np.append(cut, len(w)))[own]])
            digests = np.concatenate([digest.view(np.int64), _digests(sets, begin)])
            seed = np.arange(len(size)) < len(first)
            first = np.concatenate([first, cut[own]])
            text = np.searchsorted(head, first, "right") - 1
            take = pa.array(text + at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(first - head[text], pa.int32()), pa.array(size, pa.int32()), pa.array(digests), pa.array(seed)],
                names=["rid", "doc_id", "at", "n", "digest", "seed"],
            )


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> band keys and digests of its paragraphs, once for equal ones of a list of texts."""
    cutter = Cutter()
    for batch in batches:
        for _, texts in together(batch.column(0)):
            _, sets, owner = cutter.paragraphs(*cutter.words(texts))
            if len(sets):
                begin = _begins(owner)
                digest, first = np.unique(_digests(sets, begin), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(_bands(sets, begin)[first].view(np.int64).ravel()), pa.array(np.repeat(digest, BANDS))], names=["band", "digest"])


def seeds(w: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the seeds of texts of word hashes w that lie one behind another, `head` as in Cutter.words."""
    size = np.maximum(np.diff(head) - SEED + 1, 0)
    text = np.repeat(np.arange(len(size)), size)
    end = np.cumsum(size)
    k = np.arange(len(text))
    at = head[text] + k - (end - size)[text]
    acc = runs_of(w, SEED)[at]
    # texts stand WINNOW - 1 places apart; a text of fewer runs than a window is one window
    gap = WINNOW - 1
    place = k + gap * (text + 1)
    padded = np.full(len(k) + gap * (len(size) + 1), ~_U(0))
    padded[place] = acc
    window = place[(k + gap < end[text]) | (k == (end - size)[text])]
    least = np.zeros(len(padded), _U)
    least[window] = sliding(padded, WINNOW, np.minimum)[window]
    # the least of a window is the largest of the leasts of all windows that hold it
    chosen = np.flatnonzero(sliding(least, WINNOW, np.maximum)[place - gap] == acc)
    again = np.diff(text[chosen], prepend=-1) == 0
    chosen = chosen[~again | (size[text[chosen]] > WINNOW)]
    return at[chosen], acc[chosen]


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, top, anchors of the two -> a row for each chain of anchors on one diagonal, with the windows around it."""
    for batch in batches:
        lists = batch.column(2)
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        if not len(row):
            continue
        at, n, top_at, top_n = (c.to_numpy() for c in lists.flatten().flatten())
        order = np.lexsort((n, top_at, at, row))
        row, at, n, top_at, top_n = row[order], at[order], n[order], top_at[order], top_n[order]
        apart = (np.diff(row) != 0) | (np.diff(at) > WINDOW) | (np.abs(np.diff(at - top_at)) > WINDOW // 4)
        first = np.concatenate([[0], np.flatnonzero(apart) + 1])
        own = row[first]
        opens = np.flatnonzero(np.diff(own, prepend=-1))
        no = np.arange(len(own)) - np.repeat(opens, np.diff(np.append(opens, len(own))))
        lo, hi = np.maximum(at[first] - WINDOW, 0), np.maximum.reduceat(at + n, first) + WINDOW
        tlo, thi = np.maximum(np.minimum.reduceat(top_at, first) - WINDOW, 0), np.maximum.reduceat(top_at + top_n, first) + WINDOW
        fields = pa.StructArray.from_arrays([pa.array(c) for c in (at, n, top_at, top_n)], fields=list(_ANCHOR_TYPE.value_type))
        chains = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), fields, type=_ANCHOR_TYPE)
        take = pa.array(own)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, pa.int32()) for c in (no, lo, hi, tlo, thi)), chains], schema=_CHAIN_TYPE)


_ANCHORS = "array<struct<at: int, n: int, top_at: int, top_n: int>>"
_CHAIN = f"rid bigint, top bigint, no int, lo int, hi int, tlo int, thi int, anchors {_ANCHORS}"
_ANCHOR_TYPE = pa.list_(pa.struct([(k, pa.int32()) for k in ("at", "n", "top_at", "top_n")]))
_CHAIN_TYPE = pa.schema([("rid", pa.int64()), ("top", pa.int64()), *[(k, pa.int32()) for k in ("no", "lo", "hi", "tlo", "thi")], ("anchors", _ANCHOR_TYPE)])


def packed(w: np.ndarray) -> bytes:
    """Word hashes as numbers of three bytes."""
    return (w >> _U(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, text -> its words, packed."""
    cutter = Cutter()
    for batch in batches:
        for at, texts in together(batch.column(1)):
            *_, w, head = cutter.words(texts)
            data, to = packed(w), (3 * head).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([data[a:b] for a, b in zip(to, to[1:], strict=False)], pa.binary())], names=["rid", "words"])


def _flushed(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows whose last value is binary, in record batches of some `most` bytes of it."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[-1])
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


_WINDOW_TYPE = pa.schema([("rid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("words", pa.binary())])
_ITEMS_TYPE = pa.schema([("digest", pa.int64()), ("items", pa.binary())])


def _wants(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The first columns of each row and, one by one, what it wants: the named values of the structs in its last column."""
    for batch in batches:
        *own, want = batch.columns
        ends = want.offsets.to_pylist()
        flat = list(zip(*(want.values.field(n).to_pylist() for n in names), strict=True))
        for i in range(batch.num_rows):
            row = [c[i].as_py() for c in own]
            for w in flat[ends[i] : ends[i + 1]]:
                yield *row, *w


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, words, wanted spans -> the words of each."""
    return _flushed(((rid, lo, hi, words[3 * lo : 3 * hi]) for rid, words, lo, hi in _wants(batches, "lo", "hi")), _WINDOW_TYPE)


_STEPS = sorted(((e, f) for e in range(EDIT + 1) for f in range(EDIT + 1) if e or f), key=lambda x: (max(x), sum(x)))


def grow(a: np.ndarray, b: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """Lengths of the longest beginnings of a and b that align word by word, aligned words being num / den of all or more at each stretch's end."""
    i = j = same = 0
    best = (0, 0)
    x = y = b""
    wide, run = a.itemsize, EDIT * a.itemsize
    while True:
        n = min(len(a) - i, len(b) - j)
        eq = a[i : i + n] == b[j : j + n]
        k = n if eq.all() else int(eq.argmin())
        i, j, same = i + k, j + k, same + k
        if same and den * same >= num * (i + j - same):
            best = (i, j)
        if k < n and not x:  # short runs are compared as bytes
            x, y = a.tobytes(), b.tobytes()
        for e, f in _STEPS if k < n else ():
            p, q = wide * (i + e), wide * (j + f)
            if p + run <= len(x) and q + run <= len(y) and x[p : p + run] == y[q : q + run]:
                i, j = i + e, j + f
                break
        else:
            return best


def extend(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int, int, int]], num: int, den: int) -> list[tuple[int, int, int, int]]:
    """Spans (lo, hi, tlo, thi) of a and b that align, around anchors (first word and number of words in a, the same in b)."""
    out: list[tuple[int, int, int, int]] = []
    for at, n, top_at, top_n in anchors:
        if out and out[-1][0] <= at and at + n <= out[-1][1] and out[-1][2] <= top_at and top_at + top_n <= out[-1][3]:
            continue
        at_, top_ = at, top_at
        if n != top_n or (a[at : at + n] != b[top_at : top_at + n]).any():  # the first words that both have in a row
            runs = {b[j : j + SHINGLE].tobytes(): j for j in range(top_at + top_n - SHINGLE, top_at - 1, -1)}
            at_, top_ = next(((i, runs[r]) for i in range(at, at + n - SHINGLE + 1) if (r := a[i : i + SHINGLE].tobytes()) in runs), (None, None))
        if at_ is None:
            continue
        right, top_right = grow(a[at_:], b[top_:], num, den)
        left, top_left = grow(a[:at_][::-1], b[:top_][::-1], num, den)
        out.append((at_ - left, at_ + right, top_ - top_left, top_ + top_right))
    return out


def _extend(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ends = batch.column("anchors").offsets.to_pylist()
            flat = list(zip(*(batch.column("anchors").values.field(c).to_pylist() for c in ("at", "n", "top_at", "top_n")), strict=True))
            rows = zip(*(batch.column(c).to_pylist() for c in ("rid", "top", "lo", "tlo", "words", "top_words")), strict=True)
            for i, (rid, top, own_lo, own_tlo, words, top_words) in enumerate(rows):
                anchors = [(at - own_lo, n, top_at - own_tlo, top_n) for at, n, top_at, top_n in flat[ends[i] : ends[i + 1]]]
                for lo, hi, tlo, thi in extend(unpacked(words), unpacked(top_words), anchors, num, den):
                    out.append((rid, top, lo + own_lo, hi + own_lo, tlo + own_tlo, thi + own_tlo))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["rid", "top", "lo", "hi", "tlo", "thi"])

    return run


def _merged(spans: DataFrame, by: list[str], *also) -> DataFrame:
    """Spans (lo, hi) of each group that overlap or touch, as one; `also` are aggregates of what was merged."""
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("__new", F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0))
    return opened.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "__run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *also).drop("__run")


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """words, wanted places and digests -> digest, ordered set of the shingles there as bytes."""

    def sets() -> Iterator[tuple]:
        last, acc = None, None
        for words, at, n, digest in _wants(batches, "at", "n", "digest"):
            if words is not last:
                last, acc = words, runs_of(unpacked(words).astype(_U), SHINGLE)
            yield digest, np.unique(acc[at : at + n - SHINGLE + 1]).tobytes()

    return _flushed(sets(), _ITEMS_TYPE)


def join_small(ids: list[int], sets: list[set], scheme: Scheme) -> list[tuple[int, int]]:
    """What join_chunk gives, for sets of few elements: those linked have one in common among the rarest of either, and are compared if not joined yet."""
    links, sizes, num, den = [], [len(s) for s in sets], scheme.num, scheme.den
    few = len(sets) <= PAIRWISE
    held = Counter() if few else Counter(x for s in sets for x in s)
    under: dict[int, list[int]] = defaultdict(list)
    comp = list(range(len(ids)))
    members = {i: [i] for i in comp}
    for i, s in enumerate(sets):
        n = sizes[i]
        # as many as may be missing in a linked set, and one more
        rare = () if few else sorted(s, key=lambda x: (held[x], x))[: n + (-num * n) // den + 1]
        near = range(i) if few else {j for x in rare for j in under[x]}
        for x in rare:
            under[x].append(i)
        for j in near:
            m = sizes[j]
            if comp[i] == comp[j] or den * m < num * n or den * n < num * m:
                continue
            if (den + num) * len(s & sets[j]) >= num * (n + m):
                links.append((ids[i], ids[j]))
                a, b = sorted((comp[i], comp[j]), key=lambda c: -len(members[c]))
                for k in members[b]:
                    comp[k] = a
                members[a] += members.pop(b)
    return links


def _join(num: int, den: int):
    scheme = Scheme(num, den)

    def run(digests: list[int], items: list[bytes]) -> list[tuple]:
        sets = [np.frombuffer(x, _U) for x in items]
        if sum(map(len, sets)) <= SMALL:
            return join_small(digests, [set(s.tolist()) for s in sets], scheme)
        return join_chunk(digests, sets, scheme)

    return run


def repeats(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, block: int = BLOCK) -> DataFrame:
    """Spans of words of min_words or more: rid, doc_id, lo, hi, keep_id, removed. Those that go are apart from each other, and name the document whose copy stays; the first copies have no keep_id."""
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    places = saved(numbered.mapInArrow(_anchors, "rid bigint, doc_id bigint, at int, n int, digest bigint, seed boolean"), "places")
    found, seeded = places.where("NOT seed").drop("seed"), places.where("seed").drop("seed")
    words = numbered.select("rid", "text").mapInArrow(_pack, "rid bigint, words binary")

    # different paragraphs under one key
    keys = numbered.select("text").mapInArrow(_band_keys, "band bigint, digest bigint").repartition("band").distinct()
    w = Window.partitionBy("band")
    met = saved(keys.withColumns({"n": F.count(F.lit(1)).over(w), "i": F.row_number().over(w.orderBy("digest"))}).where("n > 1").select("band", "digest", "n", F.floor((F.col("i") - 1) / block).cast("long").alias("c")), "met")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "at", "n")
    firsts = found.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("top")).join(met.select("digest").distinct().withColumn("met", F.lit(True)), "digest", "left")
    firsts = saved(firsts.where("size > 1 OR met"), "firsts")
    want = firsts.where("met").select("digest", "top.rid", "top.at", "top.n").groupBy("rid").agg(F.collect_list(F.struct("at", "n", "digest")).alias("want"))
    sets = saved(words.join(want.hint("merge"), "rid").select("words", "want").mapInArrow(_wanted, "digest bigint, items binary"), "items")
    # every pair of blocks of a bucket is a task; a bucket of one block is one task
    blocks = F.floor((F.col("n") - 1) / block).cast("long")
    tasks = met.select("band", "digest", "c", F.explode(F.sequence(F.lit(0).cast("long"), blocks)).alias("o")).select("band", F.least("c", "o").alias("c1"), F.greatest("c", "o").alias("c2"), "digest").distinct()
    links = in_groups(tasks.join(sets, "digest"), ["band", "c1", "c2"], "digest", ["digest", "items"], _join(num, den), "a bigint, b bigint")
    labels = components(saved(links.distinct(), "links")).select(F.col("id").alias("digest"), F.col("component_id").alias("passage"))

    # anchors: repeats, each beside the first of its passage
    linked = firsts.join(labels, "digest", "left")
    first = linked.where("passage IS NOT NULL").groupBy("passage").agg(F.min("top").alias("first"))
    passages = saved(linked.join(first, "passage", "left").where("size > 1 OR passage IS NOT NULL").select("digest", "size", F.coalesce("first", "top").alias("top")), "tops")
    again = saved(seeded.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("top")).where("size > 1"), "tops")
    anchors = []
    for rows, tops in ((found, passages), (seeded, again)):
        held = join_hot(rows, tops.select("digest", "top"), ["digest"], sizes=tops.select("digest", "size"))
        anchors.append(held.where("rid != top.rid OR at != top.at").select("rid", F.col("top.rid").alias("top"), F.struct("at", "n", F.col("top.at").alias("top_at"), F.col("top.n").alias("top_n")).alias("anchor")))
    chains = saved(anchors[0].union(anchors[1]).groupBy("rid", "top").agg(F.collect_list("anchor").alias("anchors")).mapInArrow(_chains, _CHAIN), "chains")

    # the words around them, taken from both documents in one go
    spans = chains.select("rid", "lo", "hi").union(chains.select("top", "tlo", "thi")).distinct()
    want = spans.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("want"))
    own = saved(words.join(want.hint("merge"), "rid").mapInArrow(_windows, "rid bigint, lo int, hi int, words binary"), "windows")
    first = own.toDF("top", "tlo", "thi", "top_words")
    copies = chains.groupBy("top", "tlo", "thi").agg(F.count(F.lit(1)).alias("size"))
    both = join_hot(chains.join(own, ["rid", "lo", "hi"]), first, ["top", "tlo", "thi"], sizes=copies).select("rid", "top", "lo", "tlo", "anchors", "words", "top_words")
    spans = both.mapInArrow(_extend(num, den), "rid bigint, top bigint, lo bigint, hi bigint, tlo bigint, thi bigint")
    long_ = saved(_merged(spans, ["rid", "top"], F.collect_set(F.struct("tlo", "thi")).alias("tops")).where(F.col("hi") - F.col("lo") >= min_words), "spans")
    ids = numbered.select("rid", "doc_id")
    held = long_.join(ids.select(F.col("rid").alias("top"), F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col("rid").alias("r")).alias("keep")), "top")
    gone = _merged(held, ["rid"], F.min("keep").alias("keep")).select("rid", "lo", "hi", F.col("keep.doc_id").alias("keep_id"), F.lit(True).alias("removed"))
    kept = _merged(long_.select("top", F.explode("tops").alias("t")).select(F.col("top").alias("rid"), F.col("t.tlo").alias("lo"), F.col("t.thi").alias("hi")).distinct(), ["rid"])
    return gone.union(kept.select("rid", "lo", "hi", F.lit(None).cast("long"), F.lit(False))).join(ids, "rid").select("rid", "doc_id", "lo", "hi", "keep_id", "removed")


def per_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: rid, doc_id, n_repeated and repeated_words (spans of all copies), n_removed and removed_words (all but the first), keep_ids (sorted ids of documents whose copies stay)."""
    found = saved(repeats(docs, id_col=id_col, text_col=text_col, **options), "repeats")
    size = F.sum(F.col("hi") - F.col("lo"))
    all_ = _merged(found, ["rid"]).groupBy("rid").agg(F.count(F.lit(1)).alias("n_repeated"), size.alias("repeated_words"))
    gone = found.where("removed").groupBy("rid").agg(F.count(F.lit(1)).alias("n_removed"), size.alias("removed_words"), F.array_sort(F.collect_set("keep_id")).alias("keep_ids"))
    own = all_.join(gone, "rid", "left")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    out = rows.join(own, "rid", "left").na.fill(0, ["n_repeated", "repeated_words", "n_removed", "removed_words"])
    return out.withColumn("keep_ids", F.coalesce("keep_ids", F.array().cast("array<bigint>")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all rows and columns, with the removed spans cut out of the text."""
    gone = repeats(docs, id_col=id_col, text_col=text_col, **options).where("removed").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("__gone")).withColumnRenamed("rid", "__rid")

    @F.pandas_udf("string")
    def without(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for text, gone_ in zip(texts, places, strict=True):
            if text is None or gone_ is None:
                out.append(text)
                continue
            b = text.encode("utf-8", "surrogatepass")
            word = ~_WHITE[np.frombuffer(b, np.uint8)]
            starts = [*np.flatnonzero(word & ~np.concatenate([[False], word[:-1]])).tolist(), len(b)]
            at, left = 0, []
            for g in gone_:
                left.append(b[at : starts[g["lo"]]])
                at = starts[g["hi"]]
            out.append((b"".join(left) + b[at:]).decode("utf-8", "surrogatepass"))
        return pd.Series(out)

    joined = docs.withColumn("__rid", F.monotonically_increasing_id()).join(gone, "__rid", "left")
    return joined.withColumn(text_col, without(F.col(f"`{text_col}`"), "__gone")).select(*[F.col(f"`{c}`") for c in docs.columns])
