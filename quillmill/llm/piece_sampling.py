"""Subword encoding with sampled segmentations over a sentencepiece vocabulary, and lossless decoding.

Spaces are written as U+2581 and one goes in front of a text. A text is cut before each run of those marks; no piece of the
vocabulary spans such a cut, so the lattice of all segmentations of a text is a chain of the lattices of
its units. In a unit's lattice, node j stands before character j, edges are pieces, and a character that no
piece covers has an edge of its byte pieces. Forward filtering sums, at every node, the weights of all ways to
reach it; backward sampling starts at the end and picks each time the last piece with its share of that sum, so
a segmentation comes with the probability of its weight among all. The weight of a piece of rank r is
(r + RANK_SHIFT) ** -ALPHA, a Zipf law over the vocabulary's merge ranks, as a vocabulary of merges holds ranks
and no probabilities.

The numbers for the sampling come from a counter hashed with the row's key: rows are sampled alike in any partitioning and
after any retry. Many units are sampled at once, from one table that holds each node's few edges side by side. Beside the
batch handed in, what a worker holds of texts, units, tables and ids is bounded, but for a single text with its units and ids.

A literal U+2581 in a text is spelled with byte pieces, so decoding gives back every text byte for byte.

Defined results: null and empty texts give no ids and decode to the empty text; rows of the same key and text are
sampled alike; an empty table gives an empty result; other columns are kept by `encode` and `decode` but for the column they write.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA = 2.0
RANK_SHIFT = 30.0
SEED = "pieces-1"
#: Nodes kept in a worker's table before it starts anew.
MAX_NODES = 1_000_000
#: Nodes filtered at once, and bits of a share.
SLAB_NODES = 200_000
SHARE_BITS = 30
#: Characters of units that are sampled at once.
PART_CHARS = 500_000
#: Rows, and bytes of their texts, that are Python objects at once.
TEXTS = 256
TEXT_BYTES = 1_000_000
#: Units are cut into stretches of so many characters at most, so that a lattice stays small.
STRETCH = 4096
MARK = "▁"
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def row_seed(key: str | None, seed: str = SEED) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}|{key if key is not None else ''}".encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _parts(ends: np.ndarray, size: int) -> Iterator[slice]:
    """Runs of things that end at `ends` on one line, each of `size` at most or one thing long."""
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield slice(at, to)
        at = to


class Vocabulary:
    """Pieces, their weights and the byte pieces of a sentencepiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        self.id_of: dict[str, int] = {}
        self.raw: list[bytes] = [b""] * n
        ranked = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id_of[piece] = i
                self.raw[i] = piece.replace(MARK, " ").encode("utf-8")
                ranked.append(i)
        self.longest = max(map(len, self.id_of))
        rank = np.zeros(n)
        rank[ranked] = np.arange(len(ranked))
        self.weight = (rank + RANK_SHIFT) ** -ALPHA
        self.weight[0] = 0.0  # no piece: the unknown one is none
        self.byte_weight = float((len(ranked) + RANK_SHIFT) ** -ALPHA)
        self._index()

    def _index(self) -> None:
        """The prefix tree of the pieces as sorted numbers: state and character give the next state."""
        states: dict[str, int] = {"": 0}
        steps: dict[int, int] = {}
        for piece in self.id_of:
            at = 0
            for j in range(len(piece)):
                to = states.setdefault(piece[: j + 1], len(states))
                steps[(at << 21) | ord(piece[j])] = to
                at = to
        self.keys = np.array(sorted(steps), np.int64)
        self.next = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.piece_at = np.zeros(len(states), np.int32)
        for piece, i in self.id_of.items():
            self.piece_at[states[piece]] = i

    def edges(self, chars: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Pieces that end behind each character, the longest first (0: none); stop: where a character's unit ends.

        A character that no piece is has an edge of its bytes: its code point as -c - 1.
        """
        out = np.zeros((len(chars), self.longest), np.int32)
        at, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for done in range(self.longest):
            inside = at + done < stop[at]
            at, state = at[inside], state[inside]
            key = (state << 21) | chars[at + done]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[k] == key
            at, state = at[found], self.next[k[found]]
            if not len(at):
                break
            out[at + done, self.longest - 1 - done] = self.piece_at[state]
        bare = out[:, -1] == 0
        out[bare, -1] = -chars[bare] - 1
        return out

    def spelled(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces with code points (as -c - 1) spelled in bytes, and how many stand for each."""
        sizes = np.ones(len(pieces), np.int64)
        odd = np.flatnonzero(pieces < 0)
        if not len(odd):
            return pieces, sizes
        points, which = np.unique(-pieces[odd].astype(np.int64) - 1, return_inverse=True)
        coded = [chr(c).encode("utf-8", "surrogatepass") for c in points.tolist()]
        table = np.array([list(c.ljust(4, b"\0")) for c in coded])
        size = np.array([len(c) for c in coded])[which]
        sizes[odd] = size
        out = np.repeat(pieces, sizes)
        first = (np.cumsum(sizes) - sizes)[odd]
        for j in range(4):
            more = size > j
            out[first[more] + j] = self.byte_ids[table[which[more], j]]
        return out, sizes


class Lattices:
    """Sampling tables of units. The edges of node k lie from first[k] on, with their cumulative shares; the last one's is whole.

    Shares are multiples of 2 ** -SHARE_BITS, so that they don't depend on what else is in the table.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.last: dict[str, int] = {}  # the end node of a unit
        self.nodes, self.held = 0, 0
        self.first = np.zeros(1 << 16, np.int32)
        self.share, self.piece, self.back = (np.zeros(1 << 16, np.int32) for _ in range(3))

    def _room(self, names: tuple[str, ...], size: int) -> None:
        for name in names:
            old = getattr(self, name)
            if len(old) < size:
                new = np.zeros(max(size, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)

    def add(self, units: list[str]) -> None:
        """Forward filtering of many units at once, a character of each at a time."""
        v, base, width = self.v, self.nodes, self.v.longest
        n = np.array([len(u) for u in units])
        first = np.cumsum(n) - n
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        edges = v.edges(chars, np.repeat(first + n, n))
        weights = v.weight[np.maximum(edges, 0)]
        bare = edges[:, -1] < 0
        c = chars[bare]
        weights[bare, -1] = v.byte_weight ** (1 + (c > 0x7F).astype(int) + (c > 0x7FF) + (c > 0xFFFF))
        # before node 0 of a unit stand `width` zeros: no edge comes from there
        node0 = first + (width + 1) * np.arange(len(units)) + width
        total = np.zeros(len(chars) + (width + 1) * len(units))
        total[node0] = 1.0
        shares = weights
        order = np.argsort(-n, kind="stable")
        longer = np.searchsorted(-n[order], -np.arange(1, int(n.max()) + 1), "right")
        for j, k in enumerate(longer.tolist(), 1):
            some = order[:k]
            row, at = first[some] + j - 1, node0[some] + j
            reach = min(j, width)  # what stands further back adds nothing
            window = at[:, None] + np.arange(-reach, 0)
            sums = np.cumsum(total[window] * weights[row, width - reach :], axis=1)
            s = sums[:, -1]
            shares[row, width - reach :] = sums / s[:, None]
            total[at] = s
            low = s < 1e-100
            if low.any():
                total[window[low]] /= s[low][:, None]
                total[at[low]] = 1.0
        grain = float(1 << SHARE_BITS)
        flat = np.flatnonzero(edges.ravel() != 0)
        node, column = np.divmod(flat, width)
        share = np.floor(shares.ravel()[flat] * grain).astype(np.int32)
        share[column == width - 1] = 1 << SHARE_BITS
        length = width - column
        start = node - length + 1 == np.repeat(first, n)[node]
        end, nodes = self.held + len(node), base + len(chars)
        self._room(("share", "piece", "back"), end)
        self._room(("first",), nodes)
        # every node has an edge of one character, which is its last
        closes = np.flatnonzero(column == width - 1) + 1
        self.first[base:nodes] = self.held + np.concatenate([[0], closes[:-1]])
        self.share[self.held : end] = share
        self.piece[self.held : end] = edges.ravel()[flat]
        self.back[self.held : end] = np.where(start, -1, base + node - length)
        self.held, self.nodes = end, nodes
        self.last.update(zip(units, (base + first + n - 1).tolist(), strict=True))

    def sample(self, ends: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling of many units at once: pieces, in order, and their number for each unit."""
        node, who, step = ends, np.arange(len(ends)), 0
        owners, found = [], []
        count = np.zeros(len(ends), np.int64)
        while len(node):
            u = (_mix(seeds[who] + _U((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) >> _U(64 - SHARE_BITS)).astype(np.int32)
            edge = self.first[node]
            on = np.flatnonzero(self.share[edge] <= u)
            while len(on):  # the first edge whose share is beyond the number
                edge[on] += 1
                on = on[self.share[edge[on]] <= u[on]]
            owners.append(who)
            found.append(self.piece[edge])
            count[who] += 1
            node = self.back[edge]
            on = node >= 0
            node, who, step = node[on], who[on], step + 1
        end = np.cumsum(count)
        out = np.empty(int(end[-1]), np.int32)
        for back, (owner, piece) in enumerate(zip(owners, found, strict=True), 1):
            out[end[owner] - back] = piece
        return out, count


class Coder:
    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.lattices = Lattices(self.v)

    def units(self, text: str) -> list[str]:
        """Units of a text; those with a literal mark in them come back as they are and are spelled in bytes."""
        marked = MARK + text.replace(" ", MARK) if MARK not in text else None
        if marked is not None:
            out = _UNIT.findall(marked)
        else:
            out = []
            for i, part in enumerate(text.split(MARK)):
                if i:
                    out.append("\0")  # stands for a literal mark here; see encode
                if part or not i:
                    out += _UNIT.findall((MARK if not i else "") + part.replace(" ", MARK))
        return out if max(map(len, out)) <= STRETCH else [u[i : i + STRETCH] for u in out for i in range(0, len(u), STRETCH)]

    def encode(self, texts: list[str], seeds: list[int]) -> list[np.ndarray]:
        where: list[list[str]] = []
        literal: list[np.ndarray] = []
        for t in texts:
            units = self.units(t) if t else []
            where.append(units)
            # a zero character is a literal mark where the text has one and no zero character there
            literal.append(self._literal(t, units) if t and MARK in t else np.zeros(0, bool))
        n = [len(us) for us in where]
        if not sum(n):
            return [np.zeros(0, np.int32) for _ in texts]
        row = np.repeat(np.arange(len(texts)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        pieces, count = self._sampled(list(chain.from_iterable(where)), _mix(np.array(seeds, _U)[row] + _mix(place.astype(_U) + _U(1))))
        unit_end = np.cumsum(count)
        at = 0
        for k, marks in zip(n, literal, strict=True):
            if marks.any():
                pieces[unit_end[at + np.flatnonzero(marks)] - 1] = -ord(MARK) - 1
            at += k
        ids, sizes = self.v.spelled(pieces)
        stop = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], unit_end])[np.concatenate([[0], np.cumsum(n)])]]
        return [ids[i:j].astype(np.int32) for i, j in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]

    def _sampled(self, units: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled pieces of units and their number for each, PART_CHARS characters at a time, so that the table stays within MAX_NODES and a part."""
        tables, found = self.lattices, []
        ends = np.cumsum([len(u) for u in units])
        for part in _parts(ends, PART_CHARS):
            some = units[part]
            if tables.nodes > MAX_NODES:
                tables.clear()
            new = sorted(set(some) - tables.last.keys(), key=len, reverse=True)
            for slab in _parts(np.cumsum([len(u) + self.v.longest for u in new]), SLAB_NODES):
                tables.add(new[slab])
            found.append(tables.sample(np.fromiter(map(tables.last.__getitem__, some), np.int64, len(some)), seeds[part]))
        pieces, count = zip(*found, strict=True)
        return np.concatenate(pieces), np.concatenate(count)

    def _literal(self, text: str, units: list[str]) -> np.ndarray:
        """Which units stand for a literal mark: those between the parts that the marks cut the text into."""
        flags = []
        for i, part in enumerate(text.split(MARK)):
            if i:
                flags.append([True])
            if part or not i:
                own = _UNIT.findall((MARK if not i else "") + part.replace(" ", MARK))
                flags.append([False] * sum(-(-len(u) // STRETCH) for u in own))
        return np.array([x for f in flags for x in f], bool)

    def decode(self, ids: np.ndarray) -> str:
        raw = self.v.raw
        return b"".join([raw[i] for i in ids.tolist()])[1:].decode("utf-8", "surrogatepass")


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder per worker process and vocabulary."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def _encoded(keys: pa.Array, texts: pa.Array, path: str, seed: str) -> Iterator[tuple[list[str | None], list[str], list[np.ndarray]]]:
    """Keys, texts and ids of a batch's rows; at a time TEXTS rows of TEXT_BYTES in all at most, or one text."""
    c = coder(path)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    for part in _parts(ends, TEXT_BYTES):
        for at in range(part.start, part.stop, TEXTS):
            n = min(TEXTS, part.stop - at)
            ks, ts = keys.slice(at, n).to_pylist(), [t or "" for t in texts.slice(at, n).to_pylist()]
            yield ks, ts, c.encode(ts, [row_seed(k, seed) for k in ks])


def piece_ids_of(batches: Iterable[tuple[pa.Array, pa.Array]], path: str, seed: str = SEED) -> Iterator[pa.Array]:
    """Sampled piece ids of batches of keys and texts, in shorter arrays."""
    for keys, texts in batches:
        for _, _, ids in _encoded(keys, texts, path, seed):
            yield pa.array(ids, pa.list_(pa.int32()))


def piece_ids(key: Column, text: Column, path: str, seed: str = SEED) -> Column:
    """Sampled piece ids of texts, seeded by keys."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from piece_ids_of(batches, path, seed)

    return run(key, text)


def piece_text(ids: Column, path: str) -> Column:
    """The text that piece ids stand for."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = coder(path)
        for some in parts:
            yield pd.Series([c.decode(np.asarray(x)) if x is not None and len(x) else "" for x in some])

    return run(ids)


def encode(docs: DataFrame, path: str | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", out_col: str = "piece_ids") -> DataFrame:
    path = path or vocabulary_path()
    return docs.withColumn(out_col, piece_ids(F.col(f"`{id_col}`").cast("string"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")), path, seed))


def decode(docs: DataFrame, path: str | None = None, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    return docs.withColumn(out_col, piece_text(F.col(f"`{ids_col}`"), path or vocabulary_path()))


def digests(docs: DataFrame, path: str | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, after a round trip through the ids: doc_id, n_pieces, ids_crc32, lossless, decoded_md5."""
    import zlib

    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for ks, ts, coded in _encoded(batch.column(0), batch.column(1), path, seed):
                backs = [c.decode(ids) for ids in coded]
                crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in coded]
                lossless = [back == t for back, t in zip(backs, ts, strict=True)]
                md5s = [hashlib.md5(back.encode("utf-8", "surrogatepass")).hexdigest() for back in backs]
                out = [pa.array(ks, pa.string()), pa.array([len(ids) for ids in coded], pa.int64()), pa.array(crcs, pa.int64()), pa.array(lossless, pa.bool_()), pa.array(md5s, pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=["key", "n_pieces", "ids_crc32", "lossless", "decoded_md5"])

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, "key string, n_pieces bigint, ids_crc32 bigint, lossless boolean, decoded_md5 string")
    return out.select(F.col("key").cast("long").alias("doc_id"), "n_pieces", "ids_crc32", "lossless", "decoded_md5")
