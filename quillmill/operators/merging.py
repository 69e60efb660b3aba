"""Findings of several tools merged to candidates, file by file, in a fixed order and over levels.

Rows that name a source or a sink come first, then those with a line only, then those without one; inside each by position. A row joins the first
candidate that it meets at the lowest level:

1. of the same type, source and sink (texts without white space, in lower case);
2. with a source or sink: of the same type and source, named on the same line;
3. with a source: of the same type and source, on any line;
4. without either: of the same type, else family, else (categories that need no judgement) category, on the same line; a type only counts for candidates that name a flow;
5. without either: of the same family, whose flow spans the line, the one whose sink is nearest (ties: the first); without a line: the only one of its family.

Rows of level 5 that meet none are told apart by rule. A candidate keeps its first row's values, takes over what that lacks, and lists its tools and
members. The rows of a file are read in order, in one task, and of a file only its candidates are held; files are spread over tasks.

Defined results: null texts count as empty, null lines as 0 (none); equal rows are members each; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of findings; pos orders the rows of a file.
FIELDS = ["pos", "type", "family", "category", "rule", "tool", "source", "sink", "source_line", "sink_line"]
# fixed values: categories that need no judgement
DIRECT = ("secret", "sca")
OUT = "pos bigint, type string, family string, tools string, source string, sink string, source_line int, sink_line int, members array<bigint>"


def _norm(s: str) -> str:
    return "".join(s.split()).lower()


class FileMerge:
    """The candidates of one file, fed with rows in order."""

    def __init__(self):
        self.kept: list[dict] = []
        self.at: dict[tuple, int] = {}  # what a row may meet -> candidate, the first one
        self.families: dict[str, list[int]] = {}
        self.flows: dict[str, list[tuple[int, int, int, int]]] = {}  # by sink line: (sink line, candidate, lowest line, highest line)

    def _spanning(self, family: str, line: int) -> int | None:
        flows = self.flows.get(family, [])
        right = bisect_left(flows, (line,))
        left, best = right - 1, None
        while left >= 0 or right < len(flows):
            ahead = flows[right][0] - line if right < len(flows) else None
            back = line - flows[left][0] if left >= 0 else None
            near = min(x for x in (ahead, back) if x is not None)
            if best is not None and near > best[0]:
                break
            if back == near:
                spot, left = flows[left], left - 1
            else:
                spot, right = flows[right], right + 1
            if spot[2] <= line <= spot[3] and (best is None or (near, spot[1]) < best):
                best = (near, spot[1])
        return best and best[1]

    def add(self, r: dict) -> None:
        kind, family, source, sink, line = r["type"].lower(), r["family"].lower(), _norm(r["source"]), _norm(r["sink"]), r["sink_line"]
        own = ("same", kind, source, sink)
        flow = bool(source or sink)
        tries = [own] if flow else []
        if flow and line:
            tries.append(("line", kind, source, line))
        if source:
            tries.append(("source", kind, source))
        if not flow:
            own = (*own, r["rule"])
            if line:
                tries += [("flow line", kind, line), ("family line", family, line)] + ([("direct", r["category"], line)] if r["category"] in DIRECT else [])
        hit = next((self.at[t] for t in tries if t in self.at), None)
        if hit is None and not flow:
            if line:
                hit = self._spanning(family, line)
            elif len(self.families.get(family, ())) == 1:
                hit = self.families[family][0]
            if hit is None:
                hit = self.at.get(own)
        if hit is not None:
            k = self.kept[hit]
            k["tools"] |= set(r["tool"].split("+"))
            k["members"].append(r["pos"])
            for f in ("source", "sink", "source_line", "sink_line"):
                k[f] = k[f] or r[f]
            return
        n = len(self.kept)
        self.kept.append({**r, "tools": set(r["tool"].split("+")), "members": [r["pos"]]})
        self.at[own] = n
        if flow and line:
            for t in [("flow line", kind, line), ("line", kind, source, line)] + ([("source", kind, source)] if source else []):
                self.at.setdefault(t, n)
            if r["source_line"]:
                insort(self.flows.setdefault(family, []), (line, n, min(line, r["source_line"]), max(line, r["source_line"])))
        if line:
            self.at.setdefault(("family line", family, line), n)
            if r["category"] in DIRECT:
                self.at.setdefault(("direct", r["category"], line), n)
        self.families.setdefault(family, []).append(n)

    def rows(self) -> list[tuple]:
        return [(k["pos"], k["type"], k["family"], "+".join(sorted(k["tools"])), k["source"], k["sink"], k["source_line"], k["sink_line"], k["members"]) for k in self.kept]


def merge_findings(findings: DataFrame, file: str = "file") -> DataFrame:
    """(file, OUT) of findings (file, FIELDS), one row a candidate."""
    texts = ["type", "family", "category", "rule", "tool", "source", "sink"]
    flow = (F.trim(F.coalesce("source", F.lit(""))) != "") | (F.trim(F.coalesce("sink", F.lit(""))) != "")
    turn = F.when(flow, 0).when(F.coalesce("sink_line", F.lit(0)) != 0, 1).otherwise(2)
    rows = findings.select(F.col(f"`{file}`").alias("__file"), F.col("pos").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in texts], *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in ("source_line", "sink_line")], turn.alias("__turn"))
    kind = findings.schema[file].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["__file", *[x.split(" ")[0] for x in OUT.split(", ")]]
        now, state = None, None
        for p in parts:
            out = []
            for r in p.to_dict("records"):
                f = None if pd.isna(r["__file"]) else r["__file"]
                if state is None or f != now:
                    out += [(now, *x) for x in state.rows()] if state else []
                    now, state = f, FileMerge()
                state.add(r)
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame([(now, *x) for x in state.rows()], columns=names)

    placed = rows.repartition("__file").sortWithinPartitions("__file", "__turn", "pos", *[F.col(c) for c in FIELDS[1:]])
    return placed.mapInPandas(run, f"__file {kind}, {OUT}").withColumnRenamed("__file", file)
