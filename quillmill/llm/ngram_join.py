"""Similarity join of documents on word n-gram sets by a prefix tree, and its connected components.

A document's set is that of the 64-bit hashes of its word n-grams, globally ordered by hash. Two documents
link when the Jaccard similarity of their sets is at least num / den.

1. Equal sets are folded to one representative each.
2. The ordered sets are cut at common places of the hash order into as many parts as two linked sets of such
   sizes can differ in elements, and one more. Linked sets then agree in a whole part, so a hash of each
   leading part is a key under which they meet. A part holds several n-grams, so that a passage or line
   that very many documents share doesn't bring them together unless it is most of their text.
3. The sets met under keys with the same smallest member form a group. Most meet by a passage and are far from linked. So each set has
   a signature, a bitmap of 2 to 4 bits an element: the places where two of them differ are no more than the elements in which the sets do. A member
   of a group of up to SCREEN sets stays in it only if its signature lets it link with some other member; larger groups stay as they are.
4. A group is cut into chunks of bounded weight, each with that smallest member. In a chunk the ordered sets are stored in a trie; each set is walked
   through it once, sharing the overlap counted so far between all sets below a node, and a subtree is left
   as soon as the lengths still remaining can't reach the overlap that its smallest fitting member needs.
   Only links that join two sets not yet joined are emitted: a spanning forest, not all pairs.
5. In groups of several chunks that have not become one component, the pairs of chunks that may still
   hold a link are joined in the same way. No pair of sets that share a key is left out.

Defined results: null texts and texts without words have the empty set, link with nothing and are
their own component; rows are told apart by position, so repeated ids are separate rows; a component
is named by its smallest doc_id (null only if all its ids are null); an empty table gives an empty
result; other columns are ignored. The input must be repeatable (a table or a written intermediate).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, free, join_hot, saved

#: Bound on a chunk: the sum over its sets of their sizes and DOC_WEIGHT.
CHUNK_WEIGHT = 600_000
DOC_WEIGHT = 2_500
#: Groups of up to so many sets and n-grams are screened by signatures.
SCREEN, SCREEN_GRAMS = 4096, 1 << 26
#: Sizes from lo to CLASS_GROWTH * lo are cut at the same places.
CLASS_GROWTH = 1.5

_U = np.uint64
_POWER = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ONE_MORE = np.arange(1, 257, dtype=_U)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_POWER to 1, 2, ... n, and its inverse of 64 bits to 0, 1, ... n - 1."""
    inverse = np.full(n, _U(pow(int(_POWER), -1, 1 << 64)), _U)
    inverse[0] = 1
    return np.cumprod(np.full(n, _POWER, _U), dtype=_U), np.cumprod(inverse, dtype=_U)


class Shingler:
    """Ordered sets of word n-gram hashes of texts. A-Z count as a-z; words end at ASCII white space."""

    def __init__(self, k: int):
        self.k = k
        self.powers, self.inverses = _powers(1 << 17)

    def located(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First bytes and hashes of the words of a text in UTF-8. A word's polynomial is the difference of two running sums, brought back to its start."""
        b = np.frombuffer(data.lower(), np.uint8)
        word = ~_SPACE[b]
        edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return starts, np.zeros(0, _U)
        powers, inverses = (self.powers, self.inverses) if len(b) <= len(self.powers) else _powers(len(b))
        upto = np.zeros(len(b) + 1, _U)
        np.cumsum(_ONE_MORE[b] * powers[: len(b)], out=upto[1:])
        sums = (upto[ends] - upto[starts]) * inverses[starts]
        return starts, mix64(sums + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))

    def word_hashes(self, text: str) -> np.ndarray:
        return self.located(text.encode("utf-8", "surrogatepass"))[1]

    def ordered_set(self, text: str | None) -> np.ndarray:
        w = self.word_hashes(text or "")
        if not len(w):
            return w
        k = min(self.k, len(w))
        acc = np.full(len(w) - k + 1, _U(k))
        for j in range(k):
            acc = mix64(acc * _U(0xA24BAED4963EE407) + w[j : len(w) - k + 1 + j])
        return np.unique(acc)


class Scheme:
    """Where ordered sets are cut, for a least similarity of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.los = [1]

    def differ(self, a: int, b: int) -> int:
        """The most elements in one of two linked sets of these sizes and not in both."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def needed(self, a: int, b: int) -> int:
        """The least overlap of two linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.den + self.num))

    def classes(self, n: int) -> list[int]:
        """The size class of n, and the next one where a set that large may link with it."""
        while self.los[-1] <= n * self.den // self.num:
            self.los.append(int(self.los[-1] * CLASS_GROWTH) + 2)
        c = int(np.searchsorted(self.los, n, "right")) - 1
        out = [c]
        while self.los[out[-1] + 1] * self.num <= n * self.den:
            out.append(out[-1] + 1)
            if out[-1] + 1 >= len(self.los):
                self.los.append(int(self.los[-1] * CLASS_GROWTH) + 2)
        return out

    def parts(self, c: int) -> int:
        while len(self.los) <= c + 1:
            self.los.append(int(self.los[-1] * CLASS_GROWTH) + 2)
        top = self.los[c + 1] - 1
        x = self.differ(top, top * self.den // self.num) + 1
        return x + x // 6 + 2

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Hashes of the leading parts of an ordered set: two linked sets have one in common."""
        n = len(s)
        need = self.differ(n, n * self.den // self.num) + 1
        out = []
        for c in self.classes(n):
            m = self.parts(c)
            part = ((s >> _U(32)) * _U(m)) >> _U(32)
            full, first = np.unique(part, return_index=True)
            sums = np.add.reduceat(mix64(s ^ _U(0x5851F42D4C957F2D)), first)
            class_tag = _U((c + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
            tag = full * _U(0x9FB21C651E98DF25) + class_tag
            keys = mix64(sums + mix64(tag))
            if len(full) >= need:
                keys = keys[:need]
            else:  # with that few filled parts the empty ones count too
                none = np.setdiff1d(np.arange(m, dtype=_U), full)
                keys = np.concatenate([keys, mix64(mix64(none * _U(0x9FB21C651E98DF25) + class_tag))])
            out.append(keys)
        return np.concatenate(out)


def signature(s: np.ndarray) -> bytes:
    """A bitmap with a bit set for each element, of a power of two of bits, twice as many as elements or more."""
    width = max(64, 1 << (2 * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[s & _U(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def screen(sizes: list[int], signatures: list[bytes], scheme: Scheme) -> np.ndarray:
    """Which of the sets may link with another one, by their sizes and signatures."""
    order = np.argsort(sizes, kind="stable")
    n = np.array(sizes)[order]
    words = [np.frombuffer(signatures[i], "<u8") for i in order]
    ends = np.searchsorted(n, n * scheme.den // scheme.num, "right")
    may = np.zeros(len(n), bool)
    widths = np.array([len(w) for w in words])
    for width in np.unique(widths).tolist():  # sizes and widths grow together
        first, last = np.searchsorted(widths, [width, width + 1]).tolist()
        # wider bitmaps come to this width by laying their parts over each other
        table = np.stack([np.bitwise_or.reduce(w.reshape(-1, width)) for w in words[first : int(ends[last - 1])]])
        for i in range(first, last):
            near = np.arange(i + 1, int(ends[i]))
            if may[i]:
                near = near[~may[near]]
            if not len(near):
                continue
            apart = np.bitwise_count(table[near - first] ^ table[i - first]).sum(1, dtype=np.int64)
            good = near[apart <= (n[i] + n[near]) * (scheme.den - scheme.num) // (scheme.den + scheme.num)]
            may[good] = True
            may[i] |= bool(len(good))
    out = np.zeros(len(n), bool)
    out[order] = may
    return out


class _Node:
    __slots__ = ("edge", "kids", "least", "most", "ends")

    def __init__(self, edge: np.ndarray, least: int, most: int):
        self.edge, self.kids, self.least, self.most, self.ends = edge, {}, least, most, []


class Trie:
    """Prefix tree of ordered sets; an edge holds a run of elements, a node the least and most size below it."""

    def __init__(self, scheme: Scheme):
        self.scheme = scheme
        self.root = _Node(np.zeros(0, _U), 1 << 60, 0)

    def insert(self, s: np.ndarray, who: int) -> None:
        node, at, n = self.root, 0, len(s)
        node.least, node.most = min(node.least, n), max(node.most, n)
        while at < n:
            kid = node.kids.get(int(s[at]))
            if kid is None:
                leaf = _Node(s[at:], n, n)
                leaf.ends.append(who)
                node.kids[int(s[at])] = leaf
                return
            both = min(len(kid.edge), n - at)
            odd = np.flatnonzero(kid.edge[:both] != s[at : at + both])
            same = int(odd[0]) if len(odd) else both
            if same < len(kid.edge):
                top = _Node(kid.edge[:same], kid.least, kid.most)
                kid.edge = kid.edge[same:]
                top.kids[int(kid.edge[0])] = kid
                node.kids[int(top.edge[0])] = top
                kid = top
            kid.least, kid.most = min(kid.least, n), max(kid.most, n)
            node, at = kid, at + same
        node.ends.append(who)

    def linked(self, s: np.ndarray) -> Iterator[int]:
        """Who is stored and similar enough to s, as far as the caller reads on."""
        n, sch = len(s), self.scheme
        shortest, longest = -(-n * sch.num // sch.den), n * sch.den // sch.num
        todo = [(kid, 0, 0, 0) for kid in self.root.kids.values()]
        while todo:
            node, depth, shared, at = todo.pop()
            if node.most < shortest or node.least > longest:
                continue
            need = sch.needed(max(node.least, shortest), n)
            most = min(node.most, longest)
            if shared + min(most - depth, n - at) < need:
                continue
            edge, i = node.edge, 0
            while i < len(edge):  # a run at a time, so that a subtree is left early
                run = edge[i : i + 128]
                spot = np.searchsorted(s[at:], run)
                inside = spot < n - at
                hit = int(np.count_nonzero(s[at:][spot[inside]] == run[inside])) if inside.any() else 0
                shared += hit
                last = int(spot[-1])
                at += last + (1 if last < n - at and s[at + last] == run[-1] else 0)
                i += len(run)
                if shared + min(most - depth - i, n - at) < need:
                    break
            else:
                depth += len(edge)
                if node.ends and (sch.den + sch.num) * shared >= sch.num * (depth + n):
                    yield from node.ends
                todo.extend((kid, depth, shared, at) for kid in node.kids.values())


def join_chunk(ids: list[int], sets: list[np.ndarray], scheme: Scheme, joined: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between sets that join two of their components; joined: components that sets belong to already."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    trie, links = Trie(scheme), []
    comp = joined or list(range(len(ids)))
    inside: set[int] = set()
    for i, s in enumerate(sets):
        if inside and inside != {find(comp[i])}:
            for j in trie.linked(s):
                a, b = find(comp[i]), find(comp[j])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((ids[i], ids[j]))
                    inside = {find(x) for x in inside}
                    if inside == {find(comp[i])}:
                        break
        trie.insert(s, i)
        inside.add(find(comp[i]))
    return links


def _sets(k: int):
    """rid, doc_id, text -> rid, doc_id, n, digest and signature of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                n, digest, sig = [], [], []
                for text in some.column(2):
                    s = make.ordered_set(text.as_py())
                    n.append(len(s))
                    digest.append(hashlib.md5(s.tobytes()).digest())
                    sig.append(signature(s) if len(s) else b"")
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["rid", "doc_id", "n", "digest", "sig"])

    return run


def _keys(k: int, num: int, den: int):
    """rid, doc_id, text -> key, rid; of equal sets in a batch only the first gives keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, scheme = Shingler(k), Scheme(num, den)
        for batch in batches:
            seen: set[bytes] = set()
            keys, rids = [], []
            held = 0
            for rid, text in zip(batch.column(0), batch.column(2), strict=True):
                s = make.ordered_set(text.as_py())
                if not len(s) or (d := hashlib.md5(s.tobytes()).digest()) in seen:
                    continue
                seen.add(d)
                got = scheme.keys(s)
                keys.append(got.view(np.int64))
                rids.append(np.full(len(got), rid.as_py(), np.int64))
                held += len(got)
                if held > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(rids))], names=["key", "rid"])
                    keys, rids, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(rids))], names=["key", "rid"])

    return run


def _wanted_sets(k: int):
    """rid, text -> rid, set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sets = [make.ordered_set(t.as_py()).tobytes() for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.binary())], names=["rid", "items"])

    return run


def in_groups(rows: DataFrame, keys: list[str], order: str, values: list[str], fn, schema: str) -> DataFrame:
    """fn(values as lists) -> rows as tuples, for each group of rows with equal integer keys, in ascending order.

    Groups come one after another in a partition, so that many small ones cost little more than their rows; a group should be bounded.
    """
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out = None, [[] for _ in values], []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([c.to_numpy() for c in batch.columns[: len(keys)]], 1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
            cols = [c.to_pylist() for c in batch.columns[len(keys) :]]
            for lo, hi in zip(cuts, cuts[1:]):
                key = at[lo].tolist()
                if key != last:
                    if last is not None:
                        out += fn(*held)
                    last, held = key, [[] for _ in values]
                for h, c in zip(held, cols, strict=True):
                    h += c[lo:hi]
                if len(out) > 1 << 16:
                    yield made(out)
                    out = []
        if last is not None:
            out += fn(*held)
        if out:
            yield made(out)

    placed = rows.select(*[F.col(k).cast("long") for k in keys], *values).repartition(*keys)
    return placed.sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def _screened(num: int, den: int):
    scheme = Scheme(num, den)

    def run(heads: list[int], rids: list[int], n: list[int], signatures: list[bytes]) -> list[tuple]:
        return [(heads[i], rids[i], n[i]) for i in np.flatnonzero(screen(n, signatures, scheme)).tolist()]

    return run


def _join_tasks(num: int, den: int):
    scheme = Scheme(num, den)

    def run(rids: list[int], items: list[bytes], comps: list[int]) -> list[tuple]:
        return join_chunk(rids, [np.frombuffer(x, _U) for x in items], scheme, comps)

    return run


def _run_tasks(tasks: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links found in tasks (t1, t2, t3, rid, comp)."""
    return in_groups(tasks.join(sets, "rid"), ["t1", "t2", "t3"], "rid", ["rid", "items", "comp"], _join_tasks(num, den), "a bigint, b bigint")


def similarity_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", chunk_weight: int = CHUNK_WEIGHT) -> DataFrame:
    """One row per row of docs: rid (its position), doc_id, n_shingles, component (a rid), component_id."""
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    base = saved(numbered.mapInArrow(_sets(k), "rid bigint, doc_id bigint, n bigint, digest binary, sig binary"), "sets")
    reps = base.where("n > 0").groupBy("digest").agg(F.min("rid").alias("rep"))
    folded = saved(join_hot(base.select("rid", "doc_id", "n", "digest"), reps, ["digest"], "left").select("rid", "doc_id", "n", F.coalesce("rep", "rid").alias("rep")), "folded")

    keys = numbered.mapInArrow(_keys(k, num, den), "key bigint, rid bigint")
    met = keys.withColumn("head", F.min("rid").over(Window.partitionBy("key"))).where("head != rid").select("head", "rid").distinct()
    to_rep = folded.select("rid", "rep", "n")
    heads = to_rep.select(F.col("rid").alias("head"), F.col("rep").alias("h"))
    pairs = met.join(to_rep, "rid").join(heads, "head").where("h != rep").select(F.col("h").alias("head"), F.col("rep").alias("rid"), "n").distinct()
    pairs = saved(pairs, "met")
    alone = pairs.select("head").distinct().join(folded.select(F.col("rid").alias("head"), "n"), "head").select("head", F.col("head").alias("rid"), "n")

    whole = Window.partitionBy("head")
    members = saved(pairs.union(alone).withColumn("small", (F.count(F.lit(1)).over(whole) <= SCREEN) & (F.sum("n").over(whole) <= SCREEN_GRAMS)), "groups")
    signed = members.where("small").join(base.select("rid", "sig"), "rid").withColumn("at", F.col("head"))
    screened = in_groups(signed, ["at"], "rid", ["head", "rid", "n", "sig"], _screened(num, den), "head bigint, rid bigint, n bigint")
    stay = saved(members.where("NOT small").select("head", "rid", "n").union(screened), "screened")
    pairs, alone = stay.where("head != rid"), stay.where("head = rid")

    # chunks of a group; its head goes to each
    w = Window.partitionBy("head").orderBy("rid")
    weight = F.col("n") + F.lit(DOC_WEIGHT)
    cut = pairs.withColumn("chunk", F.floor((F.sum(weight).over(w) - weight) / F.lit(chunk_weight)).cast("long"))
    chunks = saved(cut.select("head", "rid", "n", "chunk"), "chunks")
    each = chunks.groupBy("head").agg(F.max("chunk").alias("last")).join(alone, "head")
    with_head = each.select("head", "rid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("chunk"))
    tasks = chunks.select("head", "rid", "chunk").union(with_head).select(F.col("head").alias("t1"), F.col("chunk").alias("t2"), F.lit(0).cast("long").alias("t3"), "rid", F.col("rid").alias("comp"))
    # the texts are shuffled once, at every size alike; the sets that met others are kept for both rounds
    wanted = tasks.select("rid").distinct().hint("merge")
    sets = saved(numbered.select("rid", "text").join(wanted, "rid", "left_semi").mapInArrow(_wanted_sets(k), "rid bigint, items binary"), "items")
    links = saved(_run_tasks(tasks, sets, num, den), "links")
    labels = saved(components(links), "components")

    # groups of several chunks that are not one component yet
    large = chunks.groupBy("head").agg(F.max("chunk").alias("last")).where("last > 0").select("head")
    if large.limit(1).count():
        members = chunks.select("head", "rid", "n").join(large, "head").union(alone.join(large, "head").select("head", "rid", "n"))
        known = members.join(labels.withColumnRenamed("id", "rid"), "rid", "left").select("head", "rid", "n", F.coalesce("component_id", "rid").alias("comp"))
        known = saved(known, "members")
        sizes = known.groupBy("head", "comp").agg(F.count(F.lit(1)).alias("size"))
        main = sizes.groupBy("head").agg(F.max(F.struct("size", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("head", F.col("m.comp").alias("main"))
        # the largest component first, the rest by size, so that most pairs of blocks can be ruled out
        order = Window.partitionBy("head").orderBy("rest", "n", "rid")
        placed = known.join(main, "head").withColumn("rest", (F.col("comp") != F.col("main")).cast("int"))
        blocks = saved(placed.withColumn("block", F.floor((F.sum(weight).over(order) - weight) / F.lit(chunk_weight)).cast("long")).select("head", "rid", "n", "comp", "rest", "block"), "blocks")
        spans = blocks.groupBy("head", "block").agg(F.max("rest").alias("rest"), F.min(F.when(F.col("rest") == 1, F.col("n"))).alias("least"), F.min("n").alias("low"), F.max("n").alias("high"))
        two = spans.select("head", F.col("block").alias("b2"), F.col("rest").alias("rest2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        may = spans.join(two, "head").where((F.col("block") <= F.col("b2")) & (F.greatest("rest", "rest2") == 1))
        may = may.where((F.col("high") * den >= F.col("low2") * num) & (F.col("high2") * den >= F.col("low") * num)).select("head", "block", "b2")
        first = may.join(blocks, ["head", "block"]).select("head", F.col("block").alias("t2"), F.col("b2").alias("t3"), "rid", "comp")
        second = may.where("block < b2").join(blocks.withColumnRenamed("block", "b2"), ["head", "b2"]).select("head", F.col("block").alias("t2"), F.col("b2").alias("t3"), "rid", "comp")
        rest = first.union(second).select(F.col("head").alias("t1"), "t2", "t3", "rid", "comp")
        more = saved(_run_tasks(saved(rest, "tasks"), sets, num, den), "links")
        if more.limit(1).count():
            labels = saved(components(links.union(more)), "components")
    # names go to the representatives first, whose rows are fewer, and from them to the copies
    own = saved(folded.groupBy("rep").agg(F.min("doc_id").alias("least")).join(labels.select(F.col("id").alias("rep"), F.col("component_id").alias("c")), "rep", "left").select("rep", "least", F.coalesce("c", "rep").alias("component")), "own")
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    named = saved(join_hot(own, least, ["component"]).select("rep", "component", "component_id"), "named")
    return join_hot(folded, named, ["rep"]).select("rid", "doc_id", F.col("n").alias("n_shingles"), "component", "component_id")


def near_dedup(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row left of each component: that of the smallest id, then position. Rows without words stay."""
    tag = free(docs, "__quillmill_rid")
    found = similarity_components(docs, k, num, den, id_col, text_col)
    stays = found.groupBy("component").agg(F.min(F.struct("doc_id", "rid")).alias("m")).select(F.col("m.rid").alias(tag))
    return docs.withColumn(tag, F.monotonically_increasing_id()).join(stays, tag, "left_semi").drop(tag)
