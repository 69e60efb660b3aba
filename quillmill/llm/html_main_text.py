"""Main text of web pages: block structure, and differencing of pages with their nearest neighbours by URL.

A page is cut into text lines, one for each block, each with a zone: the article (inside `article` or
`main`), apparatus (menus, headers, footers, sidebars, notices, adverts, forms, comments and the like, by
element name, class, id or role), or other. Every page is paired with the page of the same host whose URL path is
nearest in path order, the lines of both are aligned by a longest common subsequence, and what they share is taken for the template.
In a page that doesn't mark its article, the lines they share are deleted. A pair that shares more than COPY_SHARE of the page's characters may be two copies of one
text, which is no evidence of a template: then the page on the other side, and after it the nearest pages outside the page's run of
copies (pages of a host in path order, each a copy of the one before), are asked in turn, and the first that isn't a copy decides.
Where none is left and the host has three or more different pages, all are taken for short texts in one large template, and the nearest page
with other lines decides; with fewer, nothing is deleted.

In a page that marks articles, each innermost `article` or `main` is one part: a part whose every line is shared (cards of other
articles, the same on each page) is template and goes. Tags are the check behind it: of a part with a line of its own no line goes,
since articles do share passages with their neighbours, and lines outside the parts are no text. A neighbour that shares more than COPY_SHARE of
the parts' characters may be a copy, for which nothing goes.

Defined results: null and empty html give an empty text; pages without a usable URL, or alone on their host, have
no neighbour; repeated rows are separate pages; an empty table gives an empty result; other columns are ignored.
The input must be repeatable.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

COPY_SHARE = 0.9
MAIN, OTHER, APPARATUS = 0, 1, 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title|select)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
# fixed values: element names
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_APPARATUS = frozenset("nav footer aside form button dialog menu head".split())
_ARTICLE = frozenset("article main".split())
_CLOSED_BY_BLOCK = frozenset("p".split())
# fixed values: words of class, id and role names
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments reply replies discussion disqus respond cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login share sharing social related recommended popup modal overlay widget pagination pager toolbar search skip complementary contentinfo".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _apparatus(name: str, attributes: str, in_article: bool) -> bool:
    if name in _APPARATUS or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role") and not _WORDS.isdisjoint(_SPLIT.split(value)):
            return True
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int]]:
    """The text lines of a page in order, each with its zone."""
    return [(text, zone) for text, zone, _ in parts_of(page)]


def parts_of(page: str) -> list[tuple[str, int, int]]:
    """The text lines of a page in order, each with its zone and the number of the innermost article or main around it (0: none)."""
    out: list[tuple[str, int, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int, int]] = []  # open elements with the zone and the part inside them
    zone, part, parts = OTHER, 0, 0

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append((text, zone, part))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            if m.group(1) and m.group(1).lower() in ("script", "style", "template", "noscript", "title"):
                continue
            if m.group(1):
                held.append(" ")
            continue
        name = name.lower()
        if name == "br":
            held.append(" ")
            continue
        if m.group(2):
            if name in _VOID:
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name not in _INLINE:
                        flush()
                        del stack[i:]
                    else:
                        del stack[i]
                    break
            else:
                if name not in _INLINE:
                    flush()
            zone, part = stack[-1][1:] if stack else (OTHER, 0)
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            continue
        inside, within = zone, part
        if name not in _INLINE:
            flush()
            while stack and (stack[-1][0] in _CLOSED_BY_BLOCK or stack[-1][0] in _INLINE):  # unclosed paragraphs and what they left open
                stack.pop()
            zone, part = inside, within = stack[-1][1:] if stack else (OTHER, 0)
        if zone != APPARATUS:
            if _apparatus(name, m.group(4), zone == MAIN):
                inside = APPARATUS
            elif name in _ARTICLE:
                inside, parts = MAIN, parts + 1
                within = parts
        if name in _INLINE and inside != zone:
            flush()
        if not m.group(4).endswith("/"):
            stack.append((name, inside, within))
            zone, part = inside, within
    held.append(page[at:])
    flush()
    return out


def shared(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b, by bit vectors of a word for each line of b."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v, rows = full, []
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def difference(lines: list[str], marks: list[int], other: list[int]) -> list[str]:
    """lines without those shared with the neighbour, unless the two are copies."""
    gone = set(shared(marks, other))
    if _copies(lines, gone):
        return lines
    return [x for i, x in enumerate(lines) if i not in gone]


def _copies(lines: list[str], gone: set[int]) -> bool:
    return sum(len(lines[i]) for i in gone) > COPY_SHARE * sum(map(len, lines))


def _mark(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def template_parts(parts: list[int], marks: list[int], sizes: list[int], other: list[int]) -> list[int]:
    """The parts whose every line is shared with the neighbour; none of a page that may be a copy of it."""
    same = set(shared(marks, other))
    if sum(sizes[i] for i in same) > COPY_SHARE * sum(sizes):
        return []
    return sorted(set(parts) - {p for i, p in enumerate(parts) if i not in same})


_PARSED = "rid bigint, page_id bigint, url string, main array<string>, parts array<int>, main_marks array<bigint>, main_sizes array<int>, lines array<string>, marks array<bigint>, sizes array<int>"
_KINDS = [pa.list_(t) for t in (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32())]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of the marked parts and of the rest; the lines of the rest are kept as texts only where nothing is marked."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            rows = []
            for page in some.column(3):
                found = parts_of(page.as_py() or "")
                main = [(t, p) for t, z, p in found if z == MAIN]
                kept = [t for t, z, _ in found if z == OTHER]
                texts = [t for t, _ in main]
                rows.append((texts, [p for _, p in main], [_mark(t) for t in texts], [len(t) for t in texts], None if main else kept, [_mark(t) for t in kept], [len(t) for t in kept]))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), *cols], names=[x.split(" ")[0] for x in _PARSED.split(", ")])


def _template(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of each page that its neighbour has as well."""
    for batch in batches:
        gone = [template_parts(*row) for row in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["rid", "gone"])


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each page against its neighbour; null where the two may be copies."""
    for batch in batches:
        texts = []
        for lines, marks, other in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
            gone = set(shared(marks, other)) if other else set()
            texts.append(None if gone and _copies(lines, gone) else "\n\n".join(x for i, x in enumerate(lines) if i not in gone))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.string())], names=["rid", "page_id", "url", "text"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a page and the one before it are copies of each other (they share more than COPY_SHARE of the longer one), and whether their lines are the same."""
    for batch in batches:
        linked, same = [], []
        for marks, sizes, other, other_sizes in zip(*(batch.column(i).to_pylist() for i in (4, 5, 6, 7)), strict=True):
            same.append(other is not None and marks == other)
            linked.append(same[-1] or (other is not None and sum(sizes[i] for i in shared(marks, other)) > COPY_SHARE * max(sum(sizes), sum(other_sizes))))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(linked, pa.bool_()), pa.array(same, pa.bool_())], names=["host", "part", "pos", "rid", "linked", "same"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each page against the first of its candidates that decides."""
    for batch in batches:
        texts = []
        for lines, marks, tried, different in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6)), strict=True):
            gone: set[int] = set()
            for t in tried or []:
                found = set(shared(marks, t["marks"]))
                if different >= 3 if t["kind"] == 2 else not _copies(lines, found):
                    gone = found
                    break
            texts.append("\n\n".join(x for i, x in enumerate(lines) if i not in gone))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.string())], names=["rid", "page_id", "url", "text"])


def _placed(pages: DataFrame) -> DataFrame:
    """(rid, host, path, part): rows with a host in ranges of the order by host, path and rid."""
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    path = F.regexp_replace(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), r"(?:\.html?|/)$", "")
    rows = pages.select("rid", host.alias("host"), path.alias("path")).where("host IS NOT NULL")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(rows.repartitionByRange(parts, "host", "path", "rid").withColumn("part", F.spark_partition_id()), "paths")


def _common(path: str, other: str) -> Column:
    """Length of the common beginning of two paths."""
    n = F.least(F.length(path), F.length(other))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (i <= n) & (F.substring(path, i, F.lit(1)) == F.substring(F.col(other), i, F.lit(1))), i).otherwise(acc))


def neighbours(pages: DataFrame) -> DataFrame:
    """(rid, other): for each of (rid, url) the page of the same host with the nearest path, by the longer common beginning, then the one before.

    The order by host and path is made by ranges; pages at the edge of a range take the edge of the next one.
    """
    placed = _placed(pages)
    edge = F.struct("host", "path", "rid")
    ends = sorted(placed.groupBy("part").agg(F.min(edge).alias("low"), F.max(edge).alias("high")).collect(), key=lambda r: r["part"])  # two rows a partition
    kind = "struct<host: string, path: string, rid: bigint>"
    around = [(r["part"], ends[i - 1]["high"] if i else None, ends[i + 1]["low"] if i + 1 < len(ends) else None) for i, r in enumerate(ends)]
    beside = F.broadcast(pages.sparkSession.createDataFrame(around, f"part int, before {kind}, after {kind}"))
    w = Window.partitionBy("part").orderBy("host", "path", "rid")
    near = placed.join(beside, "part").select(
        "rid", "host", "path", F.coalesce(F.lag(edge).over(w), F.col("before")).alias("p"), F.coalesce(F.lead(edge).over(w), F.col("after")).alias("n")
    )

    def common(other: str):
        """Length of the common beginning of the two paths; -1 without a page on the same host."""
        return F.when(F.col(f"{other}.host") == F.col("host"), _common("path", f"{other}.path")).otherwise(F.lit(-1))

    both = near.select("rid", "p", "n", common("p").alias("cp"), common("n").alias("cn")).where("cp >= 0 OR cn >= 0")
    return both.select("rid", F.when(F.coalesce(F.col("cp"), F.lit(-1)) >= F.coalesce(F.col("cn"), F.lit(-1)), F.col("p.rid")).otherwise(F.col("n.rid")).alias("other"))


def _bounds(rows: DataFrame, opens: str, name: str) -> DataFrame:
    """rows (part, pos, ...) with {name}_from and {name}_to: first and last position of the run that a row is in; a run begins where `opens` holds."""
    at = F.when(F.col(opens), F.col("pos"))
    ends = sorted(rows.groupBy("part").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.max("pos").alias("last")).collect(), key=lambda r: r["part"])  # a row a partition
    before, carry = [], None
    for r in ends:
        before.append(carry)
        carry = r["high"] or carry
    after, carry = [], max((r["last"] for r in ends), default=0) + 1
    for r in reversed(ends):
        after.append(carry)
        carry = r["low"] or carry
    beside = F.broadcast(rows.sparkSession.createDataFrame([(r["part"], b, a) for r, b, a in zip(ends, before, reversed(after), strict=True)], "part int, b bigint, a bigint"))
    w = Window.partitionBy("part").orderBy("pos")
    first = F.coalesce(F.max(at).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("b"))
    last = F.coalesce(F.min(at).over(w.rowsBetween(1, Window.unboundedFollowing)), F.col("a")) - 1
    return rows.join(beside, "part").select(*rows.columns, first.alias(f"{name}_from"), last.alias(f"{name}_to"))


def beyond_copies(parsed: DataFrame, stuck: DataFrame) -> DataFrame:
    """Texts (rid, page_id, url, text) of pages whose nearest neighbour may be a copy; stuck has their rids."""
    placed = _placed(parsed.select("rid", "url"))
    placed = placed.join(placed.join(stuck.select("rid"), "rid").select("host").distinct(), "host", "left_semi")
    counts = sorted(placed.groupBy("part").count().collect())  # a row a partition
    offsets = [(r["part"], sum(x["count"] for x in counts[:i])) for i, r in enumerate(counts)]
    numbered = placed.join(F.broadcast(placed.sparkSession.createDataFrame(offsets, "part int, offset bigint")), "part")
    pos = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy("host", "path", "rid"))
    at = saved(numbered.select("rid", "host", "path", "part", pos.alias("pos")), "places")
    here = at.join(parsed.select("rid", "marks", "sizes"), "rid")
    prior = here.select("host", (F.col("pos") + 1).alias("pos"), F.col("marks").alias("p_marks"), F.col("sizes").alias("p_sizes"))
    pairs = here.join(prior, ["host", "pos"], "left").select("host", "part", "pos", "rid", "marks", "sizes", "p_marks", "p_sizes")
    links = saved(pairs.mapInArrow(_links, "host string, part int, pos bigint, rid bigint, linked boolean, same boolean"), "copies")
    runs = _bounds(_bounds(links.withColumns({"opens": ~F.col("linked"), "turns": ~F.col("same")}), "opens", "run"), "turns", "like")
    # kinds: 0 beside the page, 1 outside its run of copies, 2 the nearest with other lines
    ask = [(0, -1, F.col("pos") - 1), (0, 1, F.col("pos") + 1), (1, -1, F.col("run_from") - 1), (1, 1, F.col("run_to") + 1), (2, -1, F.col("like_from") - 1), (2, 1, F.col("like_to") + 1)]
    asked = runs.join(stuck.select("rid"), "rid").select("rid", "host", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("side"), p.alias("pos")) for k, s, p in ask])).alias("c")).select("rid", "host", "c.*")
    met = asked.join(here.select("host", "pos", F.col("path").alias("o_path"), F.col("marks").alias("o_marks")), ["host", "pos"]).join(at.select("rid", "path"), "rid")
    tried = met.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("kind", (-_common("path", "o_path")).alias("far"), "side", F.col("o_marks").alias("marks")))).alias("tried"))
    different = here.groupBy("host").agg(F.countDistinct(F.xxhash64("marks")).alias("different"))
    rows = parsed.join(stuck.select("rid"), "rid").join(at.select("rid", "host"), "rid").join(different, "host").join(tried, "rid", "left")
    return rows.select("rid", "page_id", "url", "lines", "marks", "tried", "different").mapInArrow(_settle, "rid bigint, page_id bigint, url string, text string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: rid (its position), page_id, url, text."""
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    parsed = saved(rows.mapInArrow(_parse, _PARSED), "parsed")
    beside = saved(neighbours(parsed.select("rid", "url")), "beside")
    theirs = parsed.select(F.col("rid").alias("other"), F.col("marks").alias("other_marks"), F.when(F.size("main") > 0, F.col("main_marks")).otherwise(F.col("marks")).alias("other_main"))
    pairs = parsed.where("size(main) > 0").select("rid", "parts", "main_marks", "main_sizes").join(beside, "rid").join(theirs.select("other", "other_main"), "other")
    gone = saved(pairs.select("rid", "parts", "main_marks", "main_sizes", "other_main").mapInArrow(_template, "rid bigint, gone array<int>").where("size(gone) > 0"), "template")
    whole = parsed.where("size(main) > 0").select("rid", "page_id", "url", "main", "parts").join(gone, "rid", "left")
    own = F.when(F.col("gone").isNull(), F.col("main")).otherwise(F.filter("main", lambda _, i: ~F.array_contains("gone", F.get("parts", i))))
    marked = whole.select("rid", "page_id", "url", F.array_join(own, "\n\n").alias("text"))
    open_ = parsed.where("size(main) = 0")
    other = beside.join(theirs.select("other", "other_marks"), "other").select("rid", "other_marks")
    differed = saved(open_.join(other, "rid", "left").select("rid", "page_id", "url", "lines", "marks", "other_marks").mapInArrow(_differ, "rid bigint, page_id bigint, url string, text string"), "differed")
    stuck = differed.where("text IS NULL")
    out = marked.union(differed.where("text IS NOT NULL"))
    return out.union(beyond_copies(parsed, stuck)) if stuck.limit(1).count() else out
