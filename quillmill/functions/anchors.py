"""Line numbers cited in free text ("line 7: open(path)"), moved to where the cited content stands in a text.

A citation is a mark of a line and the content behind it, up to the next mark. The line it means is the one that fits the content
best; of equal fits the one nearest to the cited number, then the first. How well a line fits, by normal forms without white space and quotes:

* 1: it is the content, or holds it (8 characters or more), accents of no matter, with or without CJK words;
* 0.95: it holds a piece of the content (a run without white space of 8 characters or more);
* else the greatest ratio of matching blocks between the line and the content or one of its pieces.

Under 0.6, and on lines that only declare imports, nothing is moved. Lines are not compared one by one: those that hold something are found by
searching the text once, and those that resemble it among the lines that share a word with it, by an index of the text's words,
and only while their lengths and letters allow a better fit. Where all citations found in a text are off by the same number, that
number also moves the ones that weren't found, if the line exists.

Defined results: null or empty text or lines leave the text as it is (null stays null); a text without marks comes back unchanged; so does
a citation that is right already.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from difflib import SequenceMatcher

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .text import by_slices, col

# fixed values: forms of a mark, declarations, CJK words, ends of a content, the bounds
MARK = r"\b(?:lines?|L)\s*(\d+)(?:\s*[-–~]\s*\d+)?(?:\s*[:：]|\s(?=\S))|第\s*(\d+)\s*(?:[-–~]\s*\d+\s*)?行\s*[:：]?"
DECLARES = r"^\s*(?:from\s+[\w.]+\s+import\b|import\b|package\s+[\w.]+\s*;|using\s+[\w.]+\s*;|#include\b)"
CJK = r"[一-鿿]+"
ASIDE, TAIL = "（，。", ";；，,。"
LEAST, PIECE, HOLDS, HOLDS_PIECE = 0.6, 8, 1.0, 0.95

_MARK, _DECLARES, _CJK, _WORD = re.compile(MARK, re.I), re.compile(DECLARES), re.compile(CJK), re.compile(r"\w+")
ANCHORED = StructType([StructField("text", StringType()), StructField("moves", ArrayType(StructType([StructField("cited", IntegerType()), StructField("line", IntegerType())])))])


def normal(text: str) -> str:
    """Without asides, white space, quotes and f-string marks, in lower case."""
    for end in ASIDE:
        text = text.strip().partition(end)[0]
    bare = text.replace('(f"', '("').replace("(f'", "('")
    return "".join(bare.split()).replace("'", "").replace('"', "").lower()


def parts_of(content: str) -> tuple[str, str, list[tuple[str, str]], set[str]]:
    """Normal form of a content, that without CJK words, what is to be found in the lines' normal forms (part, whole or plain), and the pieces among it."""
    content = content.strip().rstrip(TAIL)
    whole, plain = normal(content), normal(_CJK.sub("", content))
    pieces = {p for x in content.split() if len(x) >= PIECE and (p := x.replace("'", "").replace('"', "").lower())} - {x for x in (whole, plain) if len(x) >= PIECE}
    asked = [(part, name) for part, name in ((whole, "whole"), (plain, "plain")) if len(part) >= PIECE] + [(p, "whole") for p in pieces]
    return whole, plain, asked, pieces


class LineIndex:
    """The lines of a text, by what they hold and by their words."""

    def __init__(self, code: str):
        self.lines = code.splitlines()
        self.whole = [normal(x) for x in self.lines]
        self.plain = [normal(_CJK.sub("", x)) if _CJK.search(x) else w for x, w in zip(self.lines, self.whole, strict=True)]
        self._equal: dict[str, list[int]] = {}
        for i, w in enumerate(self.whole):
            self._equal.setdefault(w, []).append(i)
        for i, (w, p) in enumerate(zip(self.whole, self.plain, strict=True)):
            if p and p != w:
                self._equal.setdefault(p, []).append(i)
        self.fits = [not _DECLARES.match(x) for x in self.lines]
        self._texts = {}
        for name, rows in (("whole", self.whole), ("plain", self.plain)):
            starts, at = [], 0
            for r in rows:
                starts.append(at)
                at += len(r) + 1
            self._texts[name] = ("\n".join(rows), starts)
        self._words: dict[str, list[int]] | None = None
        self._held: dict[tuple[str, str], list[int]] = {}
        self._parts: dict[str, tuple] = {}

    def look_for(self, contents: list[str]) -> None:
        """Finds the lines that hold what the contents ask for, all in one pass over the text."""
        asked: dict[str, set[str]] = {"whole": set(), "plain": set()}
        for c in contents:
            self._parts[c] = parts_of(c)
            for part, name in self._parts[c][2]:
                asked[name].add(part)
        for name, parts in asked.items():
            if len(parts) < 4:
                continue  # as quick to find one by one
            words = ahocorasick.Automaton()
            for p in parts:
                words.add_word(p, p)
                self._held[p, name] = []
            words.make_automaton()
            text, starts = self._texts[name]
            for end, p in words.iter(text):
                i = bisect_right(starts, end) - 1
                held = self._held[p, name]
                if not held or held[-1] != i:
                    held.append(i)

    def holding(self, part: str, name: str) -> list[int]:
        """Numbers, from 0, of the lines that hold a part."""
        if (part, name) in self._held:
            return self._held[part, name]
        text, starts = self._texts[name]
        out, at = [], text.find(part)
        while at >= 0:
            i = bisect_right(starts, at) - 1
            out.append(i)
            at = text.find(part, starts[i + 1]) if i + 1 < len(starts) else -1
        return out

    def sharing(self, content: str) -> set[int]:
        """Lines with a word of the content."""
        if self._words is None:
            self._words = {}
            for i, line in enumerate(self.lines):
                for w in set(_WORD.findall(line.lower())):
                    self._words.setdefault(w, []).append(i)
        return {i for w in set(_WORD.findall(content.lower())) for i in self._words.get(w, ())}

    def find(self, content: str, cited: int) -> int | None:
        whole, plain, asked, pieces = self._parts.get(content) or parts_of(content)
        if not whole:
            return None
        score = dict.fromkeys([*self._equal.get(whole, ()), *(self._equal.get(plain, ()) if plain else ())], HOLDS)
        for part, name in asked:
            if part not in pieces:
                score |= dict.fromkeys(self.holding(part, name), HOLDS)
        if not any(self.fits[i] for i in score):  # pieces count for less than what is found then
            for p in pieces:
                for i in self.holding(p, "whole"):
                    score.setdefault(i, HOLDS_PIECE)
        best = max((s for i, s in score.items() if self.fits[i]), default=LEAST)
        for i in self.sharing(content) if best < HOLDS else ():
            if i in score or not self.fits[i]:
                continue
            near = 0.0
            for a, b in [(p, self.whole[i]) for p in pieces] + [(plain, self.plain[i])]:
                if not a or not b or 2 * min(len(a), len(b)) < best * (len(a) + len(b)):
                    continue
                m = SequenceMatcher(None, a, b)
                if m.quick_ratio() >= best:
                    near = max(near, m.ratio())
            if near >= best:
                score[i] = best = near
        found = [(-s, abs(i + 1 - cited), i) for i, s in score.items() if self.fits[i] and s >= LEAST]
        return min(found)[2] + 1 if found else None


def reanchor(text: str | None, code: str | None) -> tuple[str | None, list[tuple[int, int]]]:
    """The text with its citations moved, and the moves."""
    marks = list(_MARK.finditer(text)) if text and code else []
    if not marks:
        return text, []
    index = LineIndex(code)
    ends = [m.start() for m in marks[1:]] + [len(text)]
    contents = [text[m.end() : e].rstrip() if e < len(text) else text[m.end() : e] for m, e in zip(marks, ends, strict=True)]
    cited = [int(m.group(1) or m.group(2)) for m in marks]
    index.look_for(contents)
    lines = [index.find(c, n) for c, n in zip(contents, cited, strict=True)]
    apart = {f - n for f, n in zip(lines, cited, strict=True) if f is not None}
    if len(apart) == 1:
        (off,) = apart
        lines = [n + off if f is None and 1 <= n + off <= len(index.lines) else f for f, n in zip(lines, cited, strict=True)]
    out, moves, at = [], [], 0
    for m, content, n, f in zip(marks, contents, cited, lines, strict=True):
        stop = m.end() + len(content)
        out.append(text[at : m.start()])
        if f is not None and f != n:
            out.append(f"line {f}:{content}")
            moves.append((n, f))
        else:
            out.append(text[m.start() : stop])
        at = stop
    return "".join(out) + text[at:], moves


def _row(text: str | None, code: str | None) -> dict:
    out, moves = reanchor(text, code)
    return {"text": out, "moves": [{"cited": min(a, 2**31 - 1), "line": b} for a, b in moves]}


@F.arrow_udf(ANCHORED)
def _reanchored(text: pa.Array, code: pa.Array) -> pa.Array:
    return by_slices(_row, pa.struct([("text", pa.string()), ("moves", pa.list_(pa.struct([("cited", pa.int32()), ("line", pa.int32())])))]), text, code)


def reanchored(text, code) -> Column:
    """Struct: text with the cited line numbers set right by the lines of code, and the moves (cited, line). Text and lines stand in one row: nothing is shuffled."""
    return _reanchored(col(text), col(code))
