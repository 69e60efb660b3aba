"""Token ids as binary blocks with Elias-Fano document boundaries.

Documents are dealt out by ranges of doc_id and encoded in ascending order. A block holds the ids of
consecutive whole documents, concatenated as little-endian unsigned 32-bit integers, and the
boundaries between them as an Elias-Fano code: of each boundary the low l bits are stored plainly and
the rest in unary in a bit vector, about 2 + log2(ids / documents) bits each instead of 64. Every
SELECT_STEP-th one bit of that vector is sampled, so that `EliasFano.select(i)` returns a document's
offset after a scan of a few words. The doc_ids of a block are a second Elias-Fano code.

The store is a Parquet folder of rows (part, block, n_docs, n_ids, ids, bounds, doc_ids): each block is one
row of binary columns, so writing, retries and storage are Spark's own, in any file system. A block
ends at the first document that takes it past BLOCK_IDS ids; a longer document fills a block alone.

Defined results: null texts encode as empty ones (one end id); rows tied in doc_id keep the order of
their texts; rows with null doc_id come first; an empty table gives a store without blocks; other
columns are ignored. A special token of the tokenizer's file that stands in a text gets its own id, as the library does by default.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_IDS = 1 << 19
SELECT_STEP = 256
#: Byte offsets of the sections of an Elias-Fano code: six little-endian 64-bit numbers come first.
_HEAD = 6
STORE = "part int, block int, n_docs int, n_ids bigint, n_null int, ids binary, bounds binary, doc_ids binary"


class EliasFano:
    """A non-decreasing sequence of integers: head (n, base, low bits, sizes), low bits, unary high bits, samples."""

    def __init__(self, data: bytes):
        self.n, self.base, self.low_bits, lows, highs, _ = (int(x) for x in np.frombuffer(data, "<i8", _HEAD))
        at = 8 * _HEAD
        self.lows = np.frombuffer(data, np.uint8, lows, at)
        self.highs = np.frombuffer(data, np.uint8, highs, at + lows)
        self.samples = np.frombuffer(data, "<u4", -(-self.n // SELECT_STEP), at + lows + highs)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        base = int(values[0]) if n else 0
        v = values.astype(np.int64) - base
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = v & ((1 << low_bits) - 1)
        bits = ((low[:, None] >> np.arange(low_bits, dtype=np.int64)) & 1).astype(np.uint8).ravel()
        lows = np.packbits(bits, bitorder="little")
        ones = (v >> low_bits) + np.arange(n)
        vector = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        vector[ones] = 1
        highs = np.packbits(vector, bitorder="little")
        head = np.array([n, base, low_bits, len(lows), len(highs), 0], "<i8")
        return b"".join((head.tobytes(), lows.tobytes(), highs.tobytes(), ones[::SELECT_STEP].astype("<u4").tobytes()))

    def _low(self, i: int) -> int:
        at, end = i * self.low_bits, (i + 1) * self.low_bits
        word = int.from_bytes(self.lows[at >> 3 : (end + 7) >> 3].tobytes(), "little")
        return (word >> (at & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sampled one bit before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SELECT_STEP]), i % SELECT_STEP
        byte = at >> 3
        found = np.unpackbits(self.highs[byte : byte + 1], bitorder="little")
        ones = np.flatnonzero(found)
        ones = ones[ones >= (at & 7)] + 8 * byte
        while len(ones) <= left:
            left -= len(ones)
            byte += 1
            ones = np.flatnonzero(np.unpackbits(self.highs[byte : byte + 1], bitorder="little")) + 8 * byte
        return self.base + ((int(ones[left]) - i) << self.low_bits) + self._low(i)

    def all(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)) << self.low_bits
        if not self.low_bits:
            return self.base + high
        bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return self.base + high + (bits.astype(np.int64) << np.arange(self.low_bits, dtype=np.int64)).sum(1)


class _Pieces(dict):
    """Numbers of the entries of pieces; a piece that isn't there gets the next number and waits in `new`."""

    def __init__(self, known=()):
        super().__init__(known)
        self.new: list[str] = []
        self.next = 0

    def __missing__(self, piece: str) -> int:
        self[piece] = at = self.next + len(self.new)
        self.new.append(piece)
        return at


class Encoder:
    """Encodes whole texts with a byte-level BPE file of the tokenizers library.

    A text is cut before its spaces. Such a cut never falls inside a pre-token, unless the space stands between two white-space characters or
    at the end of the text after one, or a special token is about: those texts go to the library whole. Elsewhere the pieces encode apart; the ids of a piece are kept
    in a table, and the library encodes the pieces that aren't there. Latin letters with or without ASCII punctuation behind them are one pre-token
    or two, which go straight to the library's model; other pieces go through its whole chain, many in one call: a token that
    begins with a space begins a piece. When the table is full, what was met once goes.
    """

    MAX_PIECES, MAX_IDS, MAX_LENGTH = 800_000, 8_000_000, 64

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile(r"\s (?=\s|\Z)")
        # letters of Latin-1 and the two blocks after it
        self.simple = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]*)").fullmatch
        # how the file spells a byte: the library's own answer for each character of one byte in Latin-1, by its UTF-8 bytes
        self.spelled = {c: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0] for c in range(1, 0x250)}
        self.space = self.spelled[32]
        self.tails: dict[str, list[int]] = {"": []}
        n = self.tokenizer.get_vocab_size()
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(self.space) for i in range(n)])
        self._empty()

    def _empty(self) -> None:
        """No entries: of entry i the ids are ids[first[i] : first[i] + size[i]], met met[i] times. Arrays grow by doubling."""
        self.pieces = _Pieces()  # by the text after the space
        self.entries, self.held = 0, 0
        self.first, self.size, self.met = (np.zeros(1 << 12, k) for k in (np.int64, np.int32, np.int32))
        self.ids = np.zeros(1 << 14, np.uint16 if len(self.opens) <= 1 << 16 else np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, sizes: np.ndarray, ids: np.ndarray) -> int:
        """Appends entries and returns the index of the first."""
        at, end = self.entries, self.held
        self.entries, self.held = at + len(sizes), end + len(ids)
        while len(self.first) < self.entries:
            self.first, self.size, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.met))
        while len(self.ids) < self.held:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.first[at : self.entries] = end + np.cumsum(sizes) - sizes
        self.size[at : self.entries] = sizes
        self.ids[end : self.held] = ids
        self.met[at : self.entries] = 0
        return at

    def _learn(self, new: list[str]) -> None:
        """Stores the ids of new pieces, in their order."""
        found: list[list[int]] = [[]] * len(new)
        plain, other = [], []
        stems: dict[str, list[int]] = {}
        tokenize, simple, spelled, known = self.model.tokenize, self.simple, self.spelled, self.pieces.get
        for i, piece in enumerate(new):
            m = simple(piece)
            if m is None:  # printable characters are no white space
                (plain if piece and piece.isprintable() else other).append(i)
                continue
            stem, tail = m.groups()
            ids = stems.get(stem)
            if ids is None:
                at = known(stem, self.entries)
                if at < self.entries:
                    ids = self.ids[self.first[at] : self.first[at] + self.size[at]].tolist()
                else:
                    ids = [t.id for t in tokenize(self.space + (stem if stem.isascii() else stem.translate(spelled)))]
                stems[stem] = ids
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails = {"": []}
                self.tails[tail] = [t.id for t in tokenize(tail)]
            found[i] = ids + self.tails[tail]
        for k in range(0, len(plain), 1024):
            some = plain[k : k + 1024]
            ids = self._whole([" " + " ".join([new[i] for i in some])])[0]
            begins = np.flatnonzero(self.opens[ids])
            for i, x in zip(some, np.split(ids, begins[1:]), strict=True):
                found[i] = x.tolist()
        for i, x in zip(other, self._whole([" " + new[i] for i in other]) if other else [], strict=True):
            found[i] = x.tolist()
        self._store(np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.uint32))

    def _tidy(self) -> None:
        """Keeps the short pieces met twice or more, up to half the room."""
        if self.entries <= self.MAX_PIECES and self.held <= self.MAX_IDS:
            return
        often = [(w, i) for w, i in self.pieces.items() if self.met[i] > 1 and len(w) <= self.MAX_LENGTH][: self.MAX_PIECES // 2]
        ids = [self.ids[self.first[i] : self.first[i] + self.size[i]].copy() for _, i in often]
        self._empty()
        if often:
            self._store(np.array([len(x) for x in ids]), np.concatenate(ids))
        self.pieces = _Pieces((w, k) for k, (w, _) in enumerate(often))

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, each with end_id behind it, and the number of ids of each."""
        self._tidy()
        cut = [[t] if self.odd.search(t) or any(x in t for x in self.special) else t.split(" ") for t in texts]
        # what has no space before it has no entry of its own: beginnings, and whole odd texts
        apart = self._whole([ws[0] for ws in cut])
        own = self._store(np.array([*(len(x) for x in apart), 1]), np.concatenate([*apart, np.array([end_id], np.uint32)]))
        end = own + len(texts)
        self.pieces.new, self.pieces.next = [], self.entries
        number = self.pieces.__getitem__
        order: list[int] = []
        for i, ws in enumerate(cut):
            del ws[0]
            order.append(own + i)
            order.extend(map(number, ws))
            order.append(end)
        if self.pieces.new:
            self._learn(self.pieces.new)
        at = np.array(order, np.int64)
        self.met[: self.entries] += np.bincount(at, minlength=self.entries).astype(np.int32)
        sizes = self.size[at].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.first[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        closing = ends[np.flatnonzero(at == end)]
        return ids, np.diff(closing, prepend=0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _write_blocks(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        coder = encoder(path)
        docs: list = []
        ids: list[np.ndarray] = []
        sizes: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nulls = sum(d is None for d in docs)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            row = (part, block, len(docs), int(bounds[-1]), nulls, np.concatenate(ids).astype("<u4").tobytes(), EliasFano.encode(bounds), EliasFano.encode(np.array(docs[nulls:], np.int64)))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["part", "block", "n_docs", "n_ids", "n_null", "ids", "bounds", "doc_ids"])

        collecting = gc.isenabled()
        gc.disable()  # lists of millions of strings and numbers, no cycles among them
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    some = batch.slice(at, 512)
                    got, n = coder.encode(some.column(1).to_pylist(), end_id)
                    begin = 0
                    for d, end in zip(some.column(0).to_pylist(), np.cumsum(n).tolist(), strict=True):
                        docs.append(d)
                        ids.append(got[begin:end])
                        sizes.append(end - begin)
                        held += end - begin
                        begin = end
                        if held >= block_ids:
                            yield flush()
                            docs, ids, sizes, held, block = [], [], [], 0, block + 1
            if docs:
                yield flush()
        finally:
            if collecting:
                gc.enable()

    return run


def _position(value, cuts: list[int]):
    """How many of the ordered cuts lie below the value, 0 for null: first by every step-th cut, then by those between."""
    if not cuts:
        return F.lit(0)
    step = max(2, int(len(cuts) ** 0.5))
    numbers = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda c: c < value))
    coarse = below(numbers(cuts[step - 1 :: step]))
    fine = F.array(*[numbers(cuts[i : i + step - 1]) for i in range(0, len(cuts) + 1, step)])
    return F.coalesce(coarse * step + F.greatest(F.lit(0), below(F.get(fine, coarse))), F.lit(0))


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encodes every text and writes the store to a folder, in ascending order of ids."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # bounds of ranges from the ids alone: a range exchange would read the texts twice to sample them
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).first()[0] or []
    # one number a partition; searched by halves, nulls first
    part = _position(F.col("doc_id"), sorted(set(cuts)))
    placed = rows.repartitionById(len(cuts) + 1, part).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    placed.mapInArrow(_write_blocks(tokenizer, end_id, block_ids), STORE).write.option("compression", "zstd").parquet(path)


def read_store(spark: SparkSession, path: str, fold=None, kind: str | None = None) -> DataFrame:
    """One row per document, in the order of the store: part, block, pos, doc_id, start, n_tokens and the ids.

    start counts all ids of the store before the document. With fold, a function of the ids of a
    document as a numpy array, its value of SQL type kind stands in column `value` in place of the ids.
    """
    store = spark.read.schema(STORE).parquet(path)
    sizes = store.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    offset, offsets = 0, []
    for part, n in sorted(sizes.collect()):  # one row for each file written: bounded by the number of partitions
        offsets.append((part, offset))
        offset += n
    begins = F.broadcast(spark.createDataFrame(offsets, "part int, begin bigint"))
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = store.select("part", "block", "n_ids").withColumn("inside", F.coalesce(before, F.lit(0)))
    placed = blocks.join(begins, "part").select("part", "block", (F.col("begin") + F.col("inside")).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bounds = EliasFano(row["bounds"])
                edges = bounds.all()
                ids = np.frombuffer(row["ids"], "<u4")
                doc_ids = EliasFano(row["doc_ids"]).all()
                for at in range(0, row["n_docs"], 4096):
                    to = min(row["n_docs"], at + 4096)
                    some = [ids[edges[i] : edges[i + 1]] for i in range(at, to)]
                    value = pa.array([fold(x) for x in some]) if fold else pa.array([x.astype(np.int64) for x in some], pa.list_(pa.int64()))
                    names = [None if i < row["n_null"] else int(doc_ids[i - row["n_null"]]) for i in range(at, to)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["part"]] * (to - at), pa.int32()),
                            pa.array([row["block"]] * (to - at), pa.int32()),
                            pa.array(np.arange(at, to), pa.int32()),
                            pa.array(names, pa.int64()),
                            pa.array(edges[at:to], pa.int64()),
                            pa.array(np.diff(edges[at : to + 1]), pa.int64()),
                            value,
                        ],
                        names=["part", "block", "pos", "doc_id", "inside", "n_tokens", "value"],
                    )

    rows = store.select("n_docs", "n_null", "part", "block", "ids", "bounds", "doc_ids").mapInArrow(run, f"part int, block int, pos int, doc_id bigint, inside bigint, n_tokens bigint, value {kind or 'array<bigint>'}")
    return rows.join(placed, ["part", "block"]).select("part", "block", "pos", "doc_id", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "value")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())
