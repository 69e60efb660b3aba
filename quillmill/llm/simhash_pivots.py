"""Near-duplicate documents by SimHash fingerprints, compared through a table of distances to reference fingerprints (pivots).

A fingerprint has 64 bits: bit b is set if it is set in more than half of the XXH64 hashes of the text's word n-grams, repeats
included. Two documents link when their fingerprints differ in two bits at most.

1. Equal fingerprints are folded: from here on a group of copies is one row.
2. The pivots are a base fingerprint, and for each band of bits some that differ from the base inside that band only. The
   difference of the distances to such a pivot and to the base depends on the band alone, so two fingerprints that are equal in a
   band have equal differences there; of three bands, two linked fingerprints are equal in one. The differences of a band
   are the key under which they meet. Groups of over LIMIT fingerprints are cut again by the bits left (banding.meet).
3. In a group each fingerprint has its row of distances to all pivots. By the triangle inequality no coordinate of two
   linked ones differs by more than two: pairs with a larger maximum coordinate difference are discarded, a few columns at a
   time, and the survivors verified by their bits. Links that join two fingerprints not yet joined in the group are emitted.
4. Connected components name each document by the smallest doc_id it reaches.

Defined results: null texts and texts without words have the fingerprint zero and link like any other; fewer words than n are one
n-gram; rows are told apart by position, so repeated ids are separate rows; a component of null ids only is named null; an empty
table gives an empty result; other columns are ignored. Texts of any length are hashed in pieces of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .banding import BITS, bands, bits_mask, in_sorted_groups, meet
from .common import components, free, join_hot, saved
from .ngram_join import mix64

WORDS = 3
MOST_BITS = 2
#: Groups of more fingerprints are cut again by the bits left, up to LEVELS times; then 12 bits are free.
LIMIT, LEVELS = 1024, 4
#: Pivots of a band, beside the base that all bands share.
PIVOTS = 10
SLAB = 1 << 20

_U = np.uint64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
BASE = 0x5DEECE66D1234F0B


def fingerprint(data: bytes, n: int = WORDS, seed: int = 42) -> int:
    """SimHash of a text in UTF-8."""
    ones, total, carry, at = np.zeros(64, np.int64), 0, [], 0
    few = True  # fewer than n words so far
    digest = xxhash.xxh64_intdigest
    while at < len(data):
        end = at + SLAB
        cut = _SPACE.search(data, end) if end < len(data) else None
        end = cut.start() if cut else len(data)
        words = carry + data[at:end].lower().split()
        at = end
        if len(words) >= n:
            few = False
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - n + 1].tolist()
            stops = ends[n - 1 :].tolist()
            for lo in range(0, len(starts), 1 << 15):
                h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[lo : lo + (1 << 15)], stops[lo : lo + (1 << 15)])), _U)
                ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                total += len(h)
            words = words[len(words) - n + 1 :]
        carry = words
    if few:
        return digest(b" ".join(carry), seed) if carry else 0
    return bits_mask(tuple(np.flatnonzero(2 * ones > total).tolist()))


def _fingerprints(n: int, seed: int):
    """rid, doc_id, text in UTF-8 -> rid, doc_id, mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes(), n, seed) if t.is_valid else 0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(found, _U).view(np.int64))], names=["rid", "doc_id", "mask"])

    return run


def pivots_of(band: tuple[int, ...], many: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints that differ from BASE inside the band only."""
    inside = _U(bits_mask(band))
    return _U(BASE) ^ (mix64(np.arange(1, many + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + inside) & inside)


def distances(masks: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table: Hamming distances, a row for each fingerprint, a column for each pivot."""
    return np.bitwise_count(masks[:, None] ^ pivots[None, :])


def band_key(masks: np.ndarray, band: tuple[int, ...]) -> np.ndarray:
    """One number of what the band adds to the distances to its pivots."""
    apart = distances(masks, pivots_of(band)).astype(np.int64) - np.bitwise_count(masks ^ _U(BASE)).astype(np.int64)[:, None]
    out = np.zeros(len(masks), _U)
    for column in apart.T:
        out = mix64(out + (column + 128).astype(_U))
    return out


ALL_PIVOTS = np.concatenate([[_U(BASE)], *(pivots_of(b) for b in bands(BITS))])
#: Columns of the table that are compared for all pairs of a group; the others for those that are left.
FIRST = [1, 2, 1 + PIVOTS, 2 + PIVOTS, 1 + 2 * PIVOTS, 2 + 2 * PIVOTS]


def close_pairs(masks: np.ndarray, most: int = MOST_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of a group that differ in `most` bits or fewer, a block of rows at a time."""
    table = distances(masks, ALL_PIVOTS).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    table, masks = table[order], masks[order]
    ends = np.searchsorted(table[:, 0], table[:, 0] + most, "right")
    step = max(1, (1 << 22) // len(masks))
    for lo in range(0, len(masks), step):
        hi = min(lo + step, len(masks))
        right = int(ends[hi - 1])
        near = np.arange(lo, right)[None, :] > np.arange(lo, hi)[:, None]
        for c in (0, *FIRST):
            near &= np.abs(table[lo:hi, None, c] - table[None, lo:right, c]) <= most
        i, j = np.nonzero(near)
        i, j = i + lo, j + lo
        for some in range(0, len(i), 1 << 18):
            a, b = i[some : some + (1 << 18)], j[some : some + (1 << 18)]
            stay = np.abs(table[a] - table[b]).max(1) <= most  # the maximum coordinate difference
            a, b = a[stay], b[stay]
            good = np.bitwise_count(masks[a] ^ masks[b]) <= most
            yield order[a[good]], order[b[good]]


def _group_links(most: int):
    def run(table: pa.Table) -> pa.RecordBatch | None:
        masks = table.column("mask").to_numpy().view(_U)
        parent = list(range(len(masks)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for some in close_pairs(masks, most):
            for i, j in zip(some[0].tolist(), some[1].tolist(), strict=True):
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((i, j))
        if not out:
            return None
        ids = masks.view(np.int64)
        at = np.array(out)
        return pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["a", "b"])

    return run


def fingerprint_links(masks: DataFrame, limit: int = LIMIT, levels: int = LEVELS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (mask) that join all that differ in MOST_BITS bits or fewer."""
    links = None
    for rows, _ in meet(masks, band_key, levels, limit):
        found = in_sorted_groups(rows, ["path", "key"], _group_links(MOST_BITS), "a bigint, b bigint")
        links = found if links is None else links.union(found)
    return saved(links, "links")


def simhash_components(docs: DataFrame, n: int = WORDS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: rid (its position), doc_id, fingerprint (16 hex digits), component (a fingerprint), component_id."""
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    rows = saved(numbered.mapInArrow(_fingerprints(n, seed), "rid bigint, doc_id bigint, mask bigint"), "fingerprints")
    folded = saved(rows.groupBy("mask").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")), "folded")
    labels = components(fingerprint_links(folded.select("mask"), limit))
    own = saved(folded.join(labels.select(F.col("id").alias("mask"), F.col("component_id").alias("c")), "mask", "left").select("mask", "least", "size", F.coalesce("c", "mask").alias("component")), "own")
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    named = saved(join_hot(own, least, ["component"]).select("mask", "component", "component_id", "size"), "named")
    out = join_hot(rows, named.drop("size"), ["mask"], sizes=named.select("mask", "size"))
    return out.select("rid", "doc_id", F.lower(F.lpad(F.hex("mask"), 16, "0")).alias("fingerprint"), "component", "component_id")


def near_dedup(docs: DataFrame, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row left of each component: that of the smallest id, then position. Rows without words are one component and leave one row."""
    tag = free(docs, "__quillmill_rid")
    found = simhash_components(docs, n, id_col=id_col, text_col=text_col)
    stays = found.groupBy("component").agg(F.min(F.struct("doc_id", "rid")).alias("m")).select(F.col("m.rid").alias(tag))
    return docs.withColumn(tag, F.monotonically_increasing_id()).join(stays, tag, "left_semi").drop(tag)
