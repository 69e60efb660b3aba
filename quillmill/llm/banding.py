"""Values of 64 bits that differ in two bits at most meet in groups of bounded size; no pair that close is left out.

The bits are dealt into three bands: two values that differ in two bits or fewer are equal in one of them, and meet in a group
under what that band gives (a key). A group of more than `limit` values isn't compared: the bits left are dealt into three
bands again, so its values meet in smaller groups, and so on. Values are distinct where it matters, so few of them are left
together once most bits are fixed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .ngram_join import mix64

_U = np.uint64
BITS = tuple(range(64))


def bits_mask(bits: tuple[int, ...]) -> int:
    return sum(1 << b for b in bits)


def bands(free: tuple[int, ...]) -> list[tuple[int, ...]]:
    return [free[i::3] for i in range(3)]


def steps(path: int) -> list[int]:
    """The bands chosen, from the first level on; a path holds them as digits 1 to 3 of base 4."""
    out = []
    while path:
        out.append(path % 4 - 1)
        path //= 4
    return out[::-1]


def free_bits(path: int) -> tuple[int, ...]:
    """The bits that no band of the path holds."""
    free = BITS
    for c in steps(path):
        chosen = set(bands(free)[c])
        free = tuple(b for b in free if b not in chosen)
    return free


def settled_here(path: int, apart: np.ndarray) -> np.ndarray:
    """Which pairs, given by the bits in which they differ, have the first band of equal bits at each level of the path: one path for a pair."""
    ok, free = np.ones(apart.shape, bool), BITS
    for c in steps(path):
        parts = bands(free)
        for k in range(c):
            ok &= (apart & _U(bits_mask(parts[k]))) != 0
        ok &= (apart & _U(bits_mask(parts[c]))) == 0
        free = tuple(b for b in free if b not in set(parts[c]))
    return ok


def _next_level(key_of: Callable[[np.ndarray, tuple[int, ...]], np.ndarray]):
    """path, key, mask and more columns -> three rows each, a level further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, key, mask = (batch.column(i).to_numpy() for i in range(3))
            for p in np.unique(path).tolist():
                at = np.flatnonzero(path == p)
                rest = batch.take(pa.array(at))
                for c, band in enumerate(bands(free_bits(p))):
                    new = mix64(mix64(key[at].view(_U) + _U(c + 1)) ^ key_of(mask[at].view(_U), band))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p * 4 + c + 1)), pa.array(new.view(np.int64)), *rest.columns[2:]], names=batch.schema.names)

    return run


def in_sorted_runs(rows: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What fn(rows, first rows of the groups) makes of rows sorted by integer keys, some whole groups at a time: as many as an Arrow batch ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            at = np.stack([table.column(k).to_numpy() for k in keys], 1)
            cuts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1])
            if len(cuts) > 1 and (out := fn(table.slice(0, int(cuts[-1])), cuts[:-1])) is not None and out.num_rows:
                yield out
            held = table.slice(int(cuts[-1]))
        if held is not None and (out := fn(held, np.zeros(1, np.int64))) is not None and out.num_rows:
            yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def in_sorted_groups(rows: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What fn makes of each group of two rows or more with equal integer keys. Many small groups share a partition and an Arrow batch."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        ends = np.append(starts[1:], table.num_rows)
        large = np.flatnonzero(ends - starts > 1)
        out = [o for i in large.tolist() if (o := fn(table.slice(int(starts[i]), int(ends[i] - starts[i])))) is not None]
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    return in_sorted_runs(rows, keys, run, schema)


def meet(values: DataFrame, key_of: Callable[[np.ndarray, tuple[int, ...]], np.ndarray], levels: int, limit: int) -> Iterator[tuple[DataFrame, bool]]:
    """Rows (path, key, mask, more) of one level after the other whose groups are to be compared, and whether the level is the last.

    values: (mask, more) or (key, mask, more), where only values of an equal key are to meet; cheap to compute again. All groups of up to `limit`
    rows are handed out; larger ones go on a level, and at the last one the groups are handed out at any size.
    """
    start = values if "key" in values.columns else values.select(F.lit(0).cast("long").alias("key"), "*")
    start = start.select(F.lit(0).cast("long").alias("path"), "*")
    rows = start.mapInArrow(_next_level(key_of), start.schema)
    for level in range(1, levels + 1):
        if level == levels:
            yield rows, True
            return
        large = saved(rows.groupBy("path", "key").count().where(F.col("count") > limit).select("path", "key"), "large")
        if not large.limit(1).count():
            yield rows, True
            return
        yield rows.join(large, ["path", "key"], "left_anti").select(*rows.columns), False
        left = rows.join(large, ["path", "key"], "left_semi").select(*rows.columns)
        rows = saved(left.mapInArrow(_next_level(key_of), left.schema), "meet")
