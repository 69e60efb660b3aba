"""Numbered lines around the places of a finding, under a budget, with marks where lines are left out.

A text within the budget (half its characters and its line ends) comes back whole. Otherwise windows of lines around the anchors are
packed, overlapping ones merged, and halved until they fit or are at their least. A window that holds a very long line shows of its anchor's line only the
columns around the wanted text. Without an anchor, from line numbers or else from the texts, the whole text stays, as nothing may be dropped unseen.

Defined results: null text gives null; lines outside the text and null ones are no anchors; an empty text is one empty line.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import by_slices, col

# fixed values: radii in lines and characters, their least, what counts as long, the least of a segment, and the marks
LINES, LEAST_LINES, CHARS, LEAST_CHARS, LONG, SEGMENT, PIECE = 80, 16, 3000, 500, 2000, 100, 8
SKIPPED = "# …… 省略 L{}-L{}（超长上下文窗口化）……"
LONG_LINE = "# ==== 第 {} 行为超长行（{} 字符，压缩/打包产物形态），仅截取候选邻近列段 ===="
COLUMNS = "# ==== 列 L{}-{}（全文 {} 字符）===="

_BREAKS, _CITED = re.compile(r"[\s,;(){}\[\]]+"), re.compile(r"line\s*:?\s*(\d+)", re.I)


def cost(text: str) -> int:
    return len(text) // 2 + text.count("\n")


def numbered(lines: list[str], first: int) -> str:
    return "\n".join(f"{i}| {x}" for i, x in enumerate(lines, first))


def _pieces(text: str) -> list[str]:
    """Runs of a text that are long enough to be found, the longest first."""
    return sorted((p for p in _BREAKS.split(text) if len(p) >= PIECE), key=len, reverse=True) if len(text) >= PIECE else []


def anchors_of(lines: list[str], numbers: list[int], texts: list[str]) -> list[int]:
    found = sorted({n for n in numbers if n is not None and 0 < n <= len(lines)})
    if found:
        return found
    for t in texts:
        if (m := _CITED.search(t)) and 0 < int(m.group(1)) <= len(lines):
            return [int(m.group(1))]
    for t in texts:
        if (p := _pieces(t)) and (hit := next((i for i, x in enumerate(lines, 1) if p[0] in x), None)):
            return [hit]
    return []


def _columns(line: str, texts: list[str], radius: int) -> str | None:
    """The part of a line around the first of the texts' pieces in it, else around its middle."""
    spots = (at for t in texts for p in _pieces(t) if (at := line.find(p)) >= 0)
    at = next(spots, len(line) // 2)
    lo, hi = max(0, at - radius), min(len(line), at + radius)
    return None if hi - lo < SEGMENT else COLUMNS.format(lo, hi, len(line)) + "\n" + line[lo:hi]


def windowed(code: str | None, numbers, texts, budget: int) -> str | None:
    if code is None:
        return None
    lines = code.split("\n")
    texts = [t for t in (texts if texts is not None else []) if t]
    whole = numbered(lines, 1)
    if cost(whole) <= budget:
        return whole
    anchors = anchors_of(lines, [None if n is None or n != n else int(n) for n in (numbers if numbers is not None else [])], texts)
    if not anchors:
        return whole
    radius, chars = LINES, CHARS
    while True:
        parts, done = [], 0
        for a in anchors:
            lo, hi = max(done + 1, a - radius), min(len(lines), a + radius)
            if lo > hi:
                continue
            if lo > done + 1:
                parts.append(SKIPPED.format(done + 1, lo - 1))
            if max(map(len, lines[lo - 1 : hi])) <= LONG:
                parts.append(numbered(lines[lo - 1 : hi], lo))
            elif (part := _columns(lines[a - 1], texts, chars)) is not None:
                parts += [LONG_LINE.format(a, len(lines[a - 1])), part]
            done = hi
        if done < len(lines):
            parts.append(SKIPPED.format(done + 1, len(lines)))
        out = "\n".join(parts)
        if cost(out) <= budget or (radius <= LEAST_LINES and chars <= LEAST_CHARS):
            return out
        radius, chars = max(LEAST_LINES, radius // 2), max(LEAST_CHARS, chars // 2)


def windowed_context(code, numbers, texts, budget: int) -> Column:
    """Context of a text (string) around line numbers (array of integers) or else texts (array of strings), in one row: nothing is shuffled."""

    @F.arrow_udf("string")
    def make(c: pa.Array, n: pa.Array, t: pa.Array) -> pa.Array:
        return by_slices(lambda a, b, d: windowed(a, b, d, budget), pa.string(), c, n, t)

    return make(col(code), col(numbers), col(texts))
