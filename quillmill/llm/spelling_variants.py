"""Spelling variants among the words of a corpus: words one edit apart, the form of each, and the root its forms lead to.

1. Words are counted in Arrow batches and the counts added up by word, so a word that fills the corpus costs a row a batch.
2. The mask of a word has a bit for each letter, set if the letter stands in it an odd number of times. One inserted or deleted
   letter flips one bit, one replaced letter two or, where two letters share a bit, none. So of three bands of the mask two near words have one
   in common, and meet in a group under it (banding.meet; large groups are cut again by the bits left). The length filter is part of the key: a group
   holds words of two lengths one apart. So is a half of the word, as an edit leaves one half as it is; without it groups grow too large (masks of words are few).
3. In a group words are compared by length and mask, many groups at once, and those that may be near are verified
   letter by letter. A pair is reported in one group only. Each group gives a row a word: how many near words, and the best one.
4. A word's form is its near word of the largest count (ties: the first in code-point order), if that is at least twice the word's own. Roots are
   found by doubling: each round a word takes over the root that its present one has; counts double at each step, so rounds are few.

Defined results: a null text has no words; a null id counts as empty text before the colon; equal rows are counted each; words are compared as
they are after A-Z became a-z, accented letters as letters of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .banding import in_sorted_runs, meet, settled_here
from .common import join_hot, saved
from .ngram_join import mix64

#: Code points in a word, and its occurrences.
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A run in so many (by a hash of id and run) loses a letter.
ODD = 97
#: A form is at least so many times as frequent.
TIMES = 2
#: Groups of more words are cut again by the bits left, up to LEVELS times.
LIMIT, LEVELS = 1024, 3
#: Distinct words that a task holds before it passes their counts on.
HELD = 1 << 18

_U = np.uint64
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Bit of each code point: 26 for a to z, and the 38 others shared by the accented letters.
_BIT = np.array([(c - 97) if 97 <= c <= 122 else 26 + c % 38 for c in range(256)], _U)


def runs_of(doc_id: int | None, text: str | None, odd: int = ODD) -> Counter:
    """Words of a text and how often each occurs."""
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for raw, n in Counter(_RUN.findall(text or "")).items():
        word = raw.translate(_LOWER)
        h = zlib.crc32(word.encode(), start)
        if h % odd == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def _counts(odd: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, n in runs_of(doc.as_py(), text.as_py(), odd).items():
                    if len(word) >= least:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield made()
                    held = {}
        if held:
            yield made()

    return run


def masks_of(words: list[str]) -> np.ndarray:
    """Letter parities."""
    out = np.zeros(len(words), _U)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lens).tolist():
        at = np.flatnonzero(lens == n)
        letters = np.frombuffer("".join(words[i] for i in at.tolist()).encode("latin-1"), np.uint8).reshape(len(at), n)
        for some in range(0, n, 64):  # a long word is taken a piece at a time
            out[at] ^= np.bitwise_xor.reduce(_U(1) << _BIT[letters[:, some : some + 64]], axis=1)
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", odd: int = ODD, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of enough letters that occur often enough over all whole texts."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    counted = rows.mapInArrow(_counts(odd, least_letters), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _band_key(masks: np.ndarray, band: tuple[int, ...]) -> np.ndarray:
    return mix64(masks & _U(sum(1 << b for b in band)))


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words -> four rows each: under either half, as a word of the shorter and of the longer length of two lengths one apart."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        masks = pa.array(masks_of(words).view(np.int64))
        lens = np.fromiter(map(len, words), np.int64, len(words))
        for less in (0, 1):
            short = lens - less
            for side in (0, 1):
                half = [w[: s // 2] if not side else w[len(w) - (s - s // 2) :] for w, s in zip(words, short.tolist(), strict=True)]
                h = np.fromiter((zlib.crc32(x.encode()) | zlib.adler32(x.encode()) << 32 for x in half), _U, len(half))
                key = mix64(mix64(h) + (2 * short + side).astype(_U))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), masks, *batch.columns, pa.array(short.astype(np.int32)), pa.array(np.full(len(words), side, np.int32))], names=["key", "mask", "word", "n", "short", "side"])


def pairs_within(starts: np.ndarray, many: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of rows of the same group, by their distance; groups are runs of rows that begin at starts."""
    left = np.repeat(np.append(starts[1:], many), np.diff(np.append(starts, many))) - np.arange(many)
    at, apart = np.arange(many), 1
    while len(at := at[left[at] > apart]):
        yield at, at + apart
        apart += 1


def one_edit(words: list[str], lens: np.ndarray, i: np.ndarray, j: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs with lengths equal or one apart (i the shorter): which differ by one inserted, deleted or replaced letter, and which agree in the first short // 2 letters."""
    near, front = np.zeros(len(i), bool), np.zeros(len(i), bool)
    spots = np.zeros(len(words), np.int64)
    used = np.unique(np.concatenate([i, j]))
    letters = {}
    for n in np.unique(lens[used]).tolist():
        at = used[lens[used] == n]
        spots[at] = np.arange(len(at))
        letters[n] = np.frombuffer("".join(words[k] for k in at.tolist()).encode("latin-1"), np.uint8).reshape(len(at), n)
    kinds = lens[i] * 2 + (lens[j] - lens[i])
    for kind in np.unique(kinds).tolist():
        n, more = divmod(kind, 2)
        these = np.flatnonzero(kinds == kind)
        for lo in range(0, len(these), max(1, (1 << 22) // n)):
            t = these[lo : lo + max(1, (1 << 22) // n)]
            a, b = letters[n][spots[i[t]]], letters[n + more][spots[j[t]]]
            same = a == b[:, :n]
            first = np.logical_and.accumulate(same, axis=1).sum(1)
            if more:  # what is equal from the front and from the back covers the shorter one
                near[t] = first + np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1) >= n
            else:
                near[t] = (~same).sum(1) == 1
            front[t] = first >= short[t] // 2
    return near, front


def _near_rows(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
    """Groups -> word, n_near, best_n, best for each word with a near one in its group."""
    if len(starts) == table.num_rows:
        return None
    masks, n, path, short, side = (table.column(c).to_numpy() for c in ("mask", "n", "path", "short", "side"))
    masks, words = masks.view(_U), table.column("word").to_pylist()
    lens = np.fromiter(map(len, words), np.int64, len(words))
    found = []
    for i, j in pairs_within(starts, len(words)):
        flips = np.bitwise_count(masks[i] ^ masks[j])
        more = lens[j] - lens[i]
        # the shorter word has the group's length
        may = (flips <= 2) & ((flips & 1) == (more & 1)) & (np.abs(more) <= 1) & (np.minimum(lens[i], lens[j]) == short[i])
        found.append((np.where(more < 0, j, i)[may], np.where(more < 0, i, j)[may]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    apart = masks[i] ^ masks[j]
    good = np.zeros(len(i), bool)
    for p in np.unique(path[i]).tolist():
        at = np.flatnonzero(path[i] == p)
        good[at] = settled_here(p, apart[at])
    i, j = i[good], j[good]
    near, front = one_edit(words, lens, i, j, short[i])
    near &= front != (side[i] == 1)  # told under the second half only if the first ones differ
    i, j = i[near], j[near]
    if not len(i):
        return None
    src, dst = np.concatenate([i, j]), np.concatenate([j, i])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[dst], -n[dst], src))
    own, first, many = np.unique(src[order], return_index=True, return_counts=True)
    best = dst[order][first]
    names = table.column("word")
    return pa.RecordBatch.from_arrays([names.take(pa.array(own)).combine_chunks(), pa.array(many), pa.array(n[best]), names.take(pa.array(best)).combine_chunks()], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, limit: int = LIMIT, levels: int = LEVELS) -> DataFrame:
    """(word, n_near, best_n, best) of words (word, n) with a near one. words: a table or a written intermediate."""
    halves = words.select("word", "n").mapInArrow(_halves, "key bigint, mask bigint, word string, n bigint, short int, side int")
    found = None
    for rows, _ in meet(halves, _band_key, levels, limit):
        part = in_sorted_runs(rows, ["path", "key"], _near_rows, "word string, n_near bigint, best_n bigint, best string")
        found = part if found is None else found.union(part)
    first = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("f")).select("word", "n_near", (-F.col("f.m")).alias("best_n"), F.col("f.w").alias("best"))


def roots(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(word, root) of words that have a form (word, form)."""
    cur = saved(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(most_rounds):
        ahead = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = saved(join_hot(cur, ahead, ["root"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        cur = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return cur
    raise RuntimeError("roots did not settle; raise most_rounds")


def variants_of(words: DataFrame, times: int = TIMES, limit: int = LIMIT, levels: int = LEVELS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words (word, n). words: a table or a written intermediate."""
    near = saved(near_words(words, limit, levels), "near")
    is_form = F.col("best_n") >= times * F.col("n")
    known = saved(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "known")
    ends = roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per word of the corpus: word, n, n_near, form, form_n, root."""
    return variants_of(saved(vocabulary(docs, id_col, text_col), "words"), limit=limit)
