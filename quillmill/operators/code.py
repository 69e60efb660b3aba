"""Arguments of calls, origins of values and flows from sources to sinks in program texts, as joins over tokens (functions.lexer.tokens).

Everything is keyed by the text a token comes from: no join leaves a text, and texts are spread over the cluster. What depends on longer and
longer chains (flows) is computed in rounds, each a join with the edges, and each cut from its lineage in the shared folder. What was cut is never
broadcast: its files are far smaller than its rows, and the rounds would send a copy each through the driver. Only the rules are.

Flows are linear: a name stands for what was last assigned to it above, in its function or else at the top level. Functions of the same
text are followed through summaries: which parameters reach the value returned. A flow goes up from returns to callers first and
down into parameters then, so it leaves a function only to where it came from. Calls of other functions hand on what they get; sanitizers don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .checkpoints import cut as _written

# fixed values: usual sources, sinks with the class they report and its rank, and what makes a value harmless
FLOW_RULES = [
    *[("source", n, "", 0) for n in ("request", "input", "sys.argv", "location", "document.cookie", "params", "req.body", "req.query", "req.params", "getParameter")],
    *[("sink", n, "SQL Injection", 9) for n in ("execute", "executemany", "query", "raw")],
    *[("sink", n, "Command Injection", 10) for n in ("os.system", "popen", "check_output", "child_process.exec", "spawn")],
    *[("sink", n, "Code Injection", 10) for n in ("eval", "exec")],
    *[("sink", n, "Path Traversal", 7) for n in ("open", "readFile", "send_file")],
    *[("sink", n, "Cross-Site Scripting", 6) for n in ("innerHTML", "document.write", "render_template_string")],
    *[("sink", n, "Open Redirect", 5) for n in ("redirect",)],
    *[("sanitizer", n, "", 0) for n in ("escape", "quote", "int", "float", "parseInt", "Number", "sanitize", "encodeURIComponent", "literal_eval", "secure_filename")],
]
#: Paths reported for a function.
MOST_PATHS = 50


def cut(df: DataFrame) -> DataFrame:
    """df written once and read back; joins with it, or with what is selected from it, shuffle."""
    return _wide(_written(df))


def _wide(df: DataFrame) -> DataFrame:
    """df, for a join that shuffles; of unions and joins Spark doesn't hand the hint on."""
    return df.hint("merge")


def flow_rules(spark: SparkSession, rows=FLOW_RULES) -> DataFrame:
    """Rules as rows: role (source, sink, sanitizer), name (of a source the beginning, of the others the end of a dotted name), label, rank."""
    return spark.createDataFrame(rows, "role string, name string, label string, rank int")


def _first(name: str) -> Column:
    return F.split_part(name, F.lit("."), F.lit(1))


def _last(name: str) -> Column:
    return F.split_part(name, F.lit("."), F.lit(-1))


def _named(rows: DataFrame, rules: DataFrame, role: str, text: str = "text") -> DataFrame:
    """rows whose dotted name meets a rule of a role, with label and rank; the rule of the longest name decides."""
    own = rules.where(F.col("role") == role)
    part = _first if role == "source" else _last
    found = rows.withColumn("__part", part(text)).join(F.broadcast(own.select(part("name").alias("__part"), F.col("name").alias("__name"), "label", "rank")), "__part")
    dotted = F.concat(F.lit("."), text, F.lit("."))
    edge = dotted.startswith(F.concat(F.lit("."), "__name", F.lit("."))) if role == "source" else dotted.endswith(F.concat(F.lit("."), "__name", F.lit(".")))
    best = found.where(edge).groupBy(*[F.col(f"`{c}`") for c in rows.columns if c not in ("within", "params")]).agg(F.max(F.struct(F.length("__name"), "__name", "label", "rank")).alias("__m"))
    return best.select(*[c for c in rows.columns if c not in ("within", "params")], F.col("__m.label").alias("label"), F.col("__m.rank").alias("rank"))


def _inside(tokens: DataFrame) -> DataFrame:
    """Each token once for every argument it stands in."""
    return tokens.withColumn("__w", F.explode("within")).withColumns({"call": F.col("__w.call"), "n": F.col("__w.n")}).drop("__w")


_PLAIN = ("number", "string", "literal", "op", "open")


def arguments(df: DataFrame, tokens: DataFrame, key: str, code: str) -> DataFrame:
    """(key, call, callee, line, n, text, names, constant): every argument of every call, nested ones included, n from 0.

    text: as it is written; names: the dotted names used in it, sorted; constant: made of literals only. A call without arguments has no row.
    """
    calls = tokens.where("kind = 'call'").select(key, F.col("seq").alias("call"), F.col("text").alias("callee"), "line")
    name = F.when(F.col("kind") == "name", F.col("text"))
    args = _inside(tokens).groupBy(key, "call", "n").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_set(name)).alias("names"), F.bool_and(F.col("kind").isin(*_PLAIN)).alias("constant"))
    whole = df.select(F.col(f"`{key}`"), F.col(f"`{code}`").alias("__code"))
    return _wide(args.join(calls, [key, "call"])).join(whole, key).select(key, "call", "callee", "line", "n", F.expr("substring(__code, start + 1, stop - start)").alias("text"), "names", "constant")


def definitions(tokens: DataFrame, key: str) -> DataFrame:
    """(key, head, kind, var, scope, stmt, line, constant, built): assignments and returns, whether the value is made of literals only, and whether it puts a string together."""
    heads = tokens.where("kind IN ('assign', 'return')").select(key, F.col("seq").alias("head"), "kind", F.col("text").alias("var"), "scope", "stmt", "line")
    joins = (F.col("kind") == "template") | ((F.col("kind") == "op") & F.col("text").isin("+", "%")) | ((F.col("kind") == "callee") & _last("text").isin("format", "concat", "join"))
    values = tokens.where("head IS NOT NULL AND kind NOT IN ('assign', 'return')").groupBy(key, "head").agg(F.bool_and(F.col("kind").isin(*_PLAIN)).alias("constant"), F.bool_or(joins).alias("built"))
    return heads.join(values, [key, "head"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("constant", "built")})


def resolved(tokens: DataFrame, defs: DataFrame, key: str, kinds: tuple[str, ...] = ("name",)) -> DataFrame:
    """Names in use (tokens' columns) with the assignment each stands for (def, its head) or the parameter (param, from 0, of the function scope); both null if neither is known."""
    uses = tokens.where(F.col("kind").isin(*kinds)).withColumn("var", _first("text")).where("var <> '' AND (head IS NOT NULL OR size(within) > 0)")
    sets = defs.where("kind = 'assign' AND NOT contains(var, '.')").select(key, "scope", "var", "stmt", F.col("head").alias("__set"))
    marked = uses.withColumn("__set", F.lit(None).cast("int")).unionByName(sets, allowMissingColumns=True)
    w = Window.partitionBy(key, "scope", "var").orderBy("stmt", F.col("__set").isNotNull())
    own = marked.withColumn("__own", F.last("__set", ignorenulls=True).over(w)).where("__set IS NULL").drop("__set")
    params = tokens.where("kind = 'function' AND params IS NOT NULL").select(key, F.col("seq").alias("scope"), F.posexplode("params").alias("__param", "var"))
    params = params.groupBy(key, "scope", "var").agg(F.min("__param").alias("__param"))
    outer = sets.where("scope = 0").groupBy(key, "var").agg(F.max_by("__set", "stmt").alias("__outer"))
    all_ = _wide(own).join(params, [key, "scope", "var"], "left").join(_wide(outer), [key, "var"], "left")
    param = F.when(F.col("__own").isNull(), F.col("__param"))
    return all_.withColumns({"def": F.coalesce("__own", F.when(param.isNull() & (F.col("scope") != 0), F.col("__outer"))), "param": param}).drop("__own", "__param", "__outer")


def argument_origins(df: DataFrame, tokens: DataFrame, key: str, code: str, hops: int = 2) -> DataFrame:
    """arguments() with origin: literal; constant (all its names lead to literals in up to `hops` assignments); built (a string is put together from
    other values, there or in an assignment up to `hops` away); variable.
    """
    tokens = cut(tokens)  # texts are read once
    defs = cut(definitions(tokens, key))
    names = cut(resolved(tokens, defs, key))
    calls_in = tokens.where("kind = 'call' AND head IS NOT NULL").select(key, "head").distinct().withColumn("__calls", F.lit(True))
    known = cut(defs.where("kind = 'assign'").join(calls_in, [key, "head"], "left").select(key, "head", "constant", F.col("built") & ~F.col("constant"), F.coalesce("__calls", F.lit(False)).alias("calls")).toDF(key, "head", "constant", "built", "calls"))
    used = cut(names.where("head IS NOT NULL").select(key, "head", "def"))
    for _ in range(hops - 1):
        ahead = known.select(key, F.col("head").alias("def"), F.col("constant").alias("__c"), F.col("built").alias("__b"))
        seen = used.join(ahead, [key, "def"], "left").groupBy(key, "head").agg(F.bool_and(F.coalesce("__c", F.lit(False))).alias("__all"), F.bool_or(F.coalesce("__b", F.lit(False))).alias("__any"))
        step = known.join(_wide(seen), [key, "head"], "left")
        known = cut(step.select(key, "head", (F.col("constant") | (~F.col("calls") & F.coalesce("__all", F.lit(False)))).alias("constant"), (F.col("built") | F.coalesce("__any", F.lit(False))).alias("built"), "calls"))
    ahead = known.select(key, F.col("head").alias("def"), F.col("constant").alias("__c"), (F.col("built") & ~F.col("constant")).alias("__b"))
    inside = _inside(names).join(ahead, [key, "def"], "left").groupBy(key, "call", "n").agg(F.bool_and(F.coalesce("__c", F.lit(False))).alias("__all"), F.bool_or(F.coalesce("__b", F.lit(False))).alias("__any"))
    joins = (F.col("kind") == "template") | ((F.col("kind") == "op") & F.col("text").isin("+", "%")) | ((F.col("kind") == "callee") & _last("text").isin("format", "concat", "join"))
    own = _inside(tokens).groupBy(key, "call", "n").agg(F.bool_or(joins).alias("__joins"), F.bool_or(F.col("kind") == "call").alias("__calls"))
    args = arguments(df, tokens, key, code).join(_wide(inside), [key, "call", "n"], "left").join(_wide(own), [key, "call", "n"])
    yes = lambda c: F.coalesce(c, F.lit(False))
    origin = F.when(F.col("constant"), "literal").when(yes("__all") & ~F.col("__calls"), "constant").when(F.col("__joins") | yes("__any"), "built").otherwise("variable")
    return args.select(key, "call", "callee", "line", "n", "text", "names", origin.alias("origin"))


def derived(tokens: DataFrame, key: str, rules: DataFrame, hops: int = 2) -> DataFrame:
    """(key, head, var, line, hop): assignments whose value names a source (hop 0), or a variable set by such an assignment, up to `hops` further ones."""
    tokens = cut(tokens)
    defs = cut(definitions(tokens, key))
    used = cut(resolved(tokens, defs, key).where("head IS NOT NULL").select(key, "head", "def"))
    spots = tokens.where("kind IN ('name', 'callee') AND head IS NOT NULL")
    found = cut(_named(spots, rules, "source").select(key, "head").distinct().withColumn("hop", F.lit(0)))
    edge = found
    for hop in range(1, hops + 1):
        edge = cut(used.join(edge.select(key, F.col("head").alias("def")), [key, "def"]).select(key, "head").distinct().join(_wide(found), [key, "head"], "left_anti").withColumn("hop", F.lit(hop)))
        found = found.unionByName(edge)
    return found.join(defs.where("kind = 'assign'").select(key, "head", "var", "line"), [key, "head"]).select(key, "head", "var", "line", "hop")


#: Nodes are long integers: what they are, the token they belong to and, of arguments and parameters, the number.
_KINDS = {"d": 0, "c": 1, "a": 2, "p": 3}


def _node(kind: str, seq: str | Column, n: str | Column | None = None) -> Column:
    at = F.shiftleft((F.col(seq) if isinstance(seq, str) else seq).cast("long"), 26) + F.lit(_KINDS[kind] << 58)
    return at if n is None else at + (F.col(n) if isinstance(n, str) else n)


def _container() -> Column:
    """Where the value of a token goes first: an argument of the innermost call, or the assignment or return."""
    last = F.element_at("within", -1)
    return F.when(F.size("within") > 0, _node("a", last["call"], last["n"])).when(F.col("head").isNotNull(), _node("d", "head"))


def _edges(tokens: DataFrame, key: str, rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (key, a, b, line) inside functions; calls of functions of the text (key, call, f, params, line, f_line); returns (key, f, node)."""
    defs = cut(definitions(tokens, key))
    names = cut(resolved(tokens, defs, key, ("name", "callee")))
    calls = tokens.where("kind = 'call'")
    functions = tokens.where("kind = 'function' AND params IS NOT NULL AND text <> ''").select(key, F.col("seq").alias("f"), F.col("text").alias("tail"), F.size("params").alias("params"), F.col("line").alias("f_line"))
    known = cut(calls.select(key, F.col("seq").alias("call"), _last("text").alias("tail"), "line").join(functions, [key, "tail"]).drop("tail"))
    clean = _named(calls, rules, "sanitizer").select(key, F.col("seq").alias("call"))
    opaque = _wide(known.select(key, "call").union(clean).distinct())
    origin = F.when(F.col("def").isNotNull(), _node("d", "def")).when(F.col("param").isNotNull(), _node("p", "scope", "param"))
    by_name = names.where("kind = 'name'").select(key, origin.alias("a"), _container().alias("b"), "line")
    passing = _inside(tokens).select(key, "call", "n").distinct().join(opaque, [key, "call"], "left_anti")
    through = passing.join(calls.select(key, F.col("seq").alias("call"), "line"), [key, "call"]).select(key, _node("a", "call", "n").alias("a"), _node("c", "call").alias("b"), "line")
    # a method hands on its object: the bracket of a call comes right behind the callee
    owner = names.where("kind = 'callee' AND contains(text, '.')").withColumn("call", F.col("seq") + 1).join(opaque, [key, "call"], "left_anti").select(key, origin.alias("a"), _node("c", "call").alias("b"), "line")
    onward = calls.select(key, _node("c", "seq").alias("a"), _container().alias("b"), "line")
    edges = by_name.union(through).union(owner).union(onward).where("a IS NOT NULL AND b IS NOT NULL")
    returns = defs.where("kind = 'return' AND scope <> 0").select(key, F.col("scope").alias("f"), _node("d", "head").alias("node"))
    return cut(edges), known, cut(returns)


def _entries(known: DataFrame, key: str) -> DataFrame:
    """(key, call, f, n, a, line, f_line): arguments of calls of functions of the text that a parameter takes."""
    each = known.where("params > 0").select(key, "call", "f", F.explode(F.sequence(F.lit(0), F.col("params") - 1)).alias("n"), "line", "f_line")
    return each.withColumn("a", _node("a", "call", "n"))


def summaries(edges: DataFrame, known: DataFrame, returns: DataFrame, key: str) -> DataFrame:
    """(key, f, n): parameters that reach the value their function returns, through calls of other functions of the text as well.

    A fixpoint: each round takes all that is reached one edge further, and over calls by the summaries known so far.
    """
    entries = cut(_entries(known, key))
    along = edges.select(key, F.col("a").alias("node"), "b")
    over = entries.select(key, F.col("f").alias("g"), F.col("n").alias("m"), F.col("a").alias("node"), _node("c", "call").alias("b"))
    new = cut(entries.select(key, "f", "n").distinct().withColumn("node", _node("p", "f", "n")))
    reached, done, fresh = new, None, None
    while new.limit(1).count():
        found = new.join(returns, [key, "f", "node"], "left_semi").select(key, F.col("f").alias("g"), F.col("n").alias("m")).distinct()
        fresh = cut(found if done is None else found.join(done, [key, "g", "m"], "left_anti"))
        done = fresh if done is None else cut(done.union(fresh))
        # an edge further from what is new, over calls by known summaries, and from all over calls by new ones
        step = new.join(along, [key, "node"]).select(key, "f", "n", F.col("b").alias("node"))
        step = step.union(new.join(_wide(over).join(done, [key, "g", "m"], "left_semi"), [key, "node"]).select(key, "f", "n", F.col("b").alias("node")))
        if fresh.limit(1).count():
            step = step.union(_wide(reached).join(_wide(over).join(fresh, [key, "g", "m"], "left_semi"), [key, "node"]).select(key, "f", "n", F.col("b").alias("node")))
        new = cut(step.distinct().join(_wide(reached), [key, "f", "n", "node"], "left_anti"))
        reached = reached.union(new)
    return done.select(key, F.col("g").alias("f"), F.col("m").alias("n")) if done is not None else entries.select(key, "f", "n").limit(0)


def flows(tokens: DataFrame, key: str, rules: DataFrame, most: int = MOST_PATHS) -> DataFrame:
    """(key, source, source_line, sink, sink_line, label, lines): for each pair of a source and a sink that it reaches the shortest path.

    lines: those the value passes, the source's first. Of a function with more than `most` pairs those of the highest rank, then of the first
    lines, are kept (null: all). Texts without sources or sinks give no rows.
    """
    tokens = cut(tokens)
    # texts without a source or without a sink have no flow
    words = tokens.where("kind IN ('name', 'call', 'assign')").select(key, "kind", "text")
    begins = _named(words.where("kind <> 'assign'"), rules, "source").select(key)
    ends = _named(words.where("kind <> 'name'"), rules, "sink").select(key)
    both = cut(begins.distinct().join(ends.distinct(), key))
    if both.count() < tokens.select(key).distinct().count():
        tokens = cut(tokens.join(both, key, "left_semi"))
    edges, known, returns = _edges(tokens, key, rules)
    entries = _entries(known, key)
    over = entries.join(_wide(summaries(edges, known, returns, key)), [key, "f", "n"]).select(key, "a", _node("c", "call").alias("b"), "line")
    up = known.join(returns, [key, "f"]).select(key, F.col("node").alias("a"), _node("c", "call").alias("b"), "line")
    down = entries.select(key, "a", _node("p", "f", "n").alias("b"), F.col("f_line").alias("line"))
    steps = cut(edges.union(over).withColumn("way", F.lit(0)).union(up.withColumn("way", F.lit(1))).union(down.withColumn("way", F.lit(2))))

    flat = tokens.withColumn("node", F.when(F.col("kind") == "call", _node("c", "seq")).otherwise(_container()))
    spots = flat.where("kind IN ('name', 'call') AND node IS NOT NULL")
    seeds = _named(spots, rules, "source").select(key, F.col("seq").alias("origin"), F.col("text").alias("source"), F.col("line").alias("source_line"), "node")
    seen = frontier = cut(seeds.withColumns({"below": F.lit(False), "lines": F.array("source_line")}))
    while frontier.limit(1).count():
        ahead = _wide(frontier).join(steps.select(key, F.col("a").alias("node"), "b", "line", "way"), [key, "node"]).where("NOT (below AND way = 1)")
        ahead = ahead.select(key, "origin", "source", "source_line", F.col("b").alias("node"), (F.col("below") | (F.col("way") == 2)).alias("below"), F.concat("lines", F.array("line")).alias("lines"))
        fresh = ahead.join(_wide(seen), [key, "origin", "node", "below"], "left_anti").groupBy(key, "origin", "source", "source_line", "node", "below").agg(F.min("lines").alias("lines"))
        frontier = cut(fresh.select(*seen.columns))
        seen = seen.union(frontier)
    sink_calls = _named(tokens.where("kind = 'call'"), rules, "sink").select(key, F.col("seq").alias("call"), F.col("text").alias("sink"), F.col("line").alias("sink_line"), "label", "rank", "scope")
    args = _inside(tokens).select(key, "call", "n").distinct()
    ends = sink_calls.join(args, [key, "call"]).select(key, _node("a", "call", "n").alias("node"), F.col("call").alias("at"), "sink", "sink_line", "label", "rank", "scope")
    sets = _named(tokens.where("kind = 'assign'"), rules, "sink").select(key, _node("d", "seq").alias("node"), F.col("seq").alias("at"), F.col("text").alias("sink"), F.col("line").alias("sink_line"), "label", "rank", "scope")
    hits = _wide(seen).join(ends.union(sets), [key, "node"])
    best = hits.groupBy(key, "origin", "source", "source_line", "at", "sink", "sink_line", "label", "rank", "scope").agg(F.min(F.struct(F.size("lines"), F.col("lines").alias("l"))).alias("m"))
    if most is not None:
        w = Window.partitionBy(key, "scope").orderBy(F.desc("rank"), "sink_line", "source_line", "at", "origin")
        best = best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return best.select(key, "source", "source_line", "sink", "sink_line", "label", F.col("m.l").alias("lines"))
