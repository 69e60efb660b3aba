import random

from quillmill.operators import merging as M

SCHEMA = "file int, pos int, type string, family string, category string, rule string, tool string, source string, sink string, source_line int, sink_line int"


def plain(rows):
    """Each row against the list of candidates, level by level."""
    out = {}
    norm = lambda s: "".join((s or "").split()).lower()
    low = lambda s: (s or "").lower()
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    rows = [dict(zip(names, r, strict=True)) for r in rows]
    for r in rows:
        r["line"] = r["sink_line"] or 0
        r["flow"] = bool(norm(r["source"]) or norm(r["sink"]))
    order = sorted(rows, key=lambda r: (0 if r["flow"] else 1 if r["line"] else 2, r["pos"]))
    for r in order:
        kept = out.setdefault(r["file"], [])
        t, s, k = low(r["type"]), norm(r["source"]), norm(r["sink"])
        first = lambda ok: next((c for c in kept if ok(c["row"])), None)
        hit = None
        if r["flow"]:
            hit = first(lambda c: c["flow"] and (low(c["type"]), norm(c["source"]), norm(c["sink"])) == (t, s, k))
            if not hit and r["line"]:
                hit = first(lambda c: c["flow"] and c["line"] == r["line"] and (low(c["type"]), norm(c["source"])) == (t, s))
            if not hit and s:
                hit = first(lambda c: c["flow"] and c["line"] and (low(c["type"]), norm(c["source"])) == (t, s))
        else:
            if r["line"]:
                hit = first(lambda c: c["flow"] and low(c["type"]) == t and c["line"] == r["line"]) or first(lambda c: low(c["family"]) == low(r["family"]) and c["line"] == r["line"])
                if not hit and r["category"] in M.DIRECT:
                    hit = first(lambda c: c["category"] == r["category"] and c["line"] == r["line"])
                if not hit:
                    spans = [c for c in kept if c["row"]["flow"] and low(c["row"]["family"]) == low(r["family"]) and c["row"]["line"] and c["row"]["source_line"] and min(c["row"]["line"], c["row"]["source_line"]) <= r["line"] <= max(c["row"]["line"], c["row"]["source_line"])]
                    hit = min(spans, key=lambda c: abs(c["row"]["line"] - r["line"]), default=None)
            else:
                own = [c for c in kept if low(c["row"]["family"]) == low(r["family"])]
                hit = own[0] if len(own) == 1 else None
            hit = hit or first(lambda c: not c["flow"] and low(c["type"]) == t and (c["rule"] or "") == (r["rule"] or ""))
        if hit:
            hit["members"].append(r["pos"])
            hit["tools"].add(r["tool"])
        else:
            kept.append({"row": r, "members": [r["pos"]], "tools": {r["tool"]}})
    return {(f, c["row"]["pos"], "+".join(sorted(c["tools"])), tuple(c["members"])) for f, cs in out.items() for c in cs}


def test_against_a_list_of_candidates(spark):
    rng = random.Random(1)
    rows = []
    for pos in range(1500):
        flow = rng.random() < 0.4
        family = rng.choice(["sql", "path", "Path", None])
        rows.append((rng.choice([1, 1, 1, 2, 3, 4, 5, 6, None, 7]), pos, rng.choice([family, "B608"]), family, rng.choice(["secret", "taint", None]), rng.choice(["r1", "r2", None]), rng.choice("abc"),
                     rng.choice(["req", "re q", "Input", "", None]) if flow else None, rng.choice(["exec", "open (", "", " "]) if flow else " ", rng.choice([0, None, 3, 9, 20]), rng.choice([0, None, *range(1, 25)])))
    got = M.merge_findings(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert {(r.file, r.pos, r.tools, tuple(r.members)) for r in got} == plain(rows)
    assert len(got) < 900 and sum(len(r.members) for r in got) == 1500


def test_what_a_candidate_takes_over(spark):
    rows = [(1, 5, "X", "x", "", "r", "a", "", "", None, 7), (1, 9, "X", "x", "", "r", "b", "in", "", 3, 7), (1, 10, "X", "x", "", "r", "c", "in", "run", 2, 9), (1, 11, "X", "x", "", "q", "d", "", "", 0, 0), (1, 11, "X", "x", "", "q", "d", "", "", 0, 0)]
    (r,) = M.merge_findings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (r.pos, r.tools, r.source, r.sink, r.source_line, r.sink_line, r.members) == (9, "a+b+c+d", "in", "run", 3, 7, [9, 10, 5, 11, 11])
    assert M.merge_findings(spark.createDataFrame([], SCHEMA)).count() == 0
