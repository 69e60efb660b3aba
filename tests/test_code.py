import random

from quillmill.functions import lexer as L
from quillmill.operators import code as C

PY = '''
import os
def run(cmd, how=1):
    # os.system(cmd)
    os.system("echo " + cmd)

def wrap(x):
    y = f"<{x}>"
    return y

def main(request):
    a = request.args.get("q")
    b = wrap(a)
    run(b, 2)
    c = escape(a)
    eval(c)
    d = "SELECT ?"
    cursor.execute(d, (a,))
    d += "fixed"
    open(d)
'''


def texts(spark, rows):
    return spark.createDataFrame([(i, c, h) for i, (c, h) in enumerate(rows)], "k int, code string, hash boolean")


def tokens(df):
    from pyspark.sql import functions as F

    return L.tokens(df, "k", "code", F.col("hash"))


def plain_arguments(code):
    """(callee, n, text) by a scan of characters with a stack."""
    out, stack, i, quote = [], [], 0, None
    while i < len(code):
        c = code[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = None
        elif c in "'\"":
            quote = c
        elif c in "([{":
            j = i
            while j and (code[j - 1].isalnum() or code[j - 1] in "_."):
                j -= 1
            name = code[j:i] if c == "(" else ""
            stack.append([name if name and not name[0].isdigit() else None, i + 1, 0])
        elif c == "," and stack and stack[-1][0]:
            out.append((stack[-1][0], stack[-1][2], code[stack[-1][1] : i].strip()))
            stack[-1][1:] = [i + 1, stack[-1][2] + 1]
        elif c in ")]}":
            name, start, n = stack.pop()
            if name and code[start:i].strip():
                out.append((name, n, code[start:i].strip()))
        i += 1
    return sorted(out)


def expression(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(["x", "12", '"a,(b"', "'it\\'s)'", "req.body", "y"])
    kind = rng.randrange(4)
    inner = ", ".join(expression(rng, depth - 1) for _ in range(rng.randrange(1, 4)))
    if kind == 0:
        return f"{rng.choice(['f', 'g.h', 'open'])}({inner})"
    if kind == 1:
        return f"[{inner}]"
    if kind == 2:
        return f"{expression(rng, depth - 1)} + {expression(rng, depth - 1)}"
    return f"g({inner},  {{a: {expression(rng, depth - 1)}}})"


def test_arguments_against_a_stack_scan(spark):
    rng = random.Random(1)
    codes = [";\n".join(expression(rng, 4) for _ in range(5)) for _ in range(60)]
    df = texts(spark, [(c, False) for c in codes])
    got: dict[int, list] = {}
    for r in C.arguments(df, tokens(df), "k", "code").collect():
        got.setdefault(r.k, []).append((r.callee, r.n, r.text))
    assert sum(map(len, got.values())) > 300
    for i, c in enumerate(codes):
        assert sorted(got.get(i, [])) == plain_arguments(c)


def test_lexer_states():
    rows = L.tokens_of("f(a /* , b( */, `x${c}`) // g(1\nif (x) { y = 1 }")
    assert [(r["kind"], r["text"]) for r in rows if r["kind"] not in ("op", "open")][:6] == [("callee", "f"), ("call", "f"), ("name", "a"), ("template", "`x${c}`"), ("name", "c"), ("name", "x")]
    assert [w["n"] for r in rows for w in r["within"]] == [0, 1, 1]
    odd = L.tokens_of("f(a, [b; 'never closed\n) ] } g(")
    assert [r["text"] for r in odd if r["kind"] == "call"] == ["f", "g"]
    assert L.tokens_of(None) == L.tokens_of("") == []
    scopes = {r["text"]: r["scope"] for r in L.tokens_of(PY, True) if r["kind"] == "assign"}
    assert scopes["y"] != scopes["a"] != 0
    assert [r["params"] for r in L.tokens_of(PY, True) if r["kind"] == "function"] == [["cmd", "how"], ["x"], ["request"]]


def test_origins(spark):
    js = 'var a = "x"; var b = a; var c = b; var d = q + 1; var e = d;\nf(1, a, b, c, d, e, q, g(a), "p" + a, "p" + q);'
    df = texts(spark, [(js, False), (None, False), ("", True)])
    got = {(r.callee, r.n): r.origin for r in C.argument_origins(df, tokens(df), "k", "code").collect()}
    want = ["literal", "constant", "constant", "variable", "built", "built", "variable", "variable", "constant", "built"]
    assert [got["f", n] for n in range(10)] == want and got["g", 0] == "constant"
    far = {(r.callee, r.n): r.origin for r in C.argument_origins(df, tokens(df), "k", "code", hops=3).collect()}
    assert far["f", 3] == "constant"


def test_names_derived_in_two_steps(spark):
    df = texts(spark, [("a = request.args\nb = a\nc = b\nd = c\na = 1\ne = a\n", True)])
    got = sorted((r.var, r.line, r.hop) for r in C.derived(tokens(df), "k", C.flow_rules(spark)).collect())
    assert got == [("a", 1, 0), ("b", 2, 1), ("c", 3, 2)]


def test_flows_of_a_program(spark):
    df = texts(spark, [(PY, True), ("x = 1\n", True), (None, True), ("el.innerHTML = location.hash;", False)])
    got = {(r.k, r.source_line, r.sink, r.sink_line): r.lines for r in C.flows(tokens(df), "k", C.flow_rules(spark)).collect()}
    assert set(got) == {(0, 12, "os.system", 5), (0, 12, "cursor.execute", 18), (3, 1, "el.innerHTML", 1)}
    assert got[0, 12, "os.system", 5][0] == 12 and got[0, 12, "os.system", 5][-1] == 5


class Program:
    """Functions that call later ones only, and the flows that running every function with each call inlined gives."""

    def __init__(self, rng):
        self.lines, self.bodies, many = [], [], rng.randrange(1, 5)
        for f in range(many):
            params = [f"p{i}" for i in range(rng.randrange(0, 3))]
            self.lines.append(f"def f{f}({', '.join(params)}):")
            names, body = [*params, "v0"], []
            for _ in range(rng.randrange(3, 10)):
                self.lines.append("")
                at = len(self.lines)
                new, a, b = f"v{rng.randrange(4)}", rng.choice(names[-3:]), rng.choice(names)
                kind = rng.choice(["source", "source", "copy", "join", "clean", "other", "call", "call", "call", "sink", "sink", "return", "return", "nested"])
                if kind in ("call", "nested") and f + 1 == many:
                    kind = "other"
                g = rng.randrange(f + 1, many) if f + 1 < many else None
                text = {"source": f"{new} = input()", "copy": f"{new} = {a}", "join": f"{new} = {a} + {b}", "clean": f"{new} = escape({a}, {b})", "other": f"{new} = other({a}, 1)", "call": f"{new} = f{g}({a}, {b})", "sink": f"eval({a})", "return": f"return {a}", "nested": f"eval(f{g}({a}, escape({b})))"}[kind]
                self.lines[-1] = "    " + text
                body.append((kind, at, new, a, b, g))
                if kind in ("source", "copy", "join", "clean", "other", "call"):
                    names.append(new)
            self.bodies.append((params, body))
        self.hits = set()
        for f in range(many):
            self.run(f, [set(), set()])

    def run(self, f, args):
        params, body = self.bodies[f]
        env, back = dict(zip(params, args)), set()
        for kind, at, new, a, b, g in body:
            x, y = env.get(a, set()), env.get(b, set())
            if kind == "sink":
                self.hits |= {(s, at) for s in x}
            elif kind == "return":
                back |= x
            elif kind == "nested":
                self.hits |= {(s, at) for s in self.run(g, [x, set()])}
            else:
                env[new] = {"source": {at}, "copy": x, "join": x | y, "clean": set(), "other": x}[kind] if kind != "call" else self.run(g, [x, y])
        return back


def test_flows_against_inlined_runs(spark):
    rng = random.Random(7)
    programs = [Program(rng) for _ in range(250)]
    df = texts(spark, [("\n".join(p.lines), True) for p in programs])
    got: dict[int, set] = {}
    for r in C.flows(tokens(df), "k", C.flow_rules(spark), most=None).collect():
        got.setdefault(r.k, set()).add((r.source_line, r.sink_line))
        assert r.lines[0] == r.source_line and r.lines[-1] == r.sink_line
    assert sum(len(p.hits) for p in programs) > 100
    for i, p in enumerate(programs):
        assert got.get(i, set()) == p.hits, "\n".join(p.lines)


def test_recursion_ends_and_most_paths_are_the_first(spark):
    code = "def f(a):\n    b = f(a)\n    return a\nx = input()\n" + "".join("eval(f(x))\nopen(x)\n" for _ in range(40))
    df = texts(spark, [(code, True)])
    rows = C.flows(tokens(df), "k", C.flow_rules(spark)).collect()
    assert len(rows) == 50 and sum(r.label == "Code Injection" for r in rows) == 40
    assert sorted(r.sink_line for r in rows if r.label == "Path Traversal") == list(range(6, 26, 2))
    assert len(C.flows(tokens(df), "k", C.flow_rules(spark), most=None).collect()) == 80
