"""Queries of program texts: cited lines, arguments of calls, origins of values, flows, and rules that come as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import anchors as A
from ..functions import context as T
from ..functions import lexer as L
from ..operators import code as C
from ..operators import fixes as X
from ..operators import merging as M
from ..operators import rules as R
from .registry import query, table

# citations of all lines of a text, each two lines off and without its first word
_CITED = """array_join(filter(transform(split(text, '\\n'), (l, i) -> if(length(regexp_replace(substring_index(l, ' ', -size(split(l, ' ')) + 1), '[\\\\s"\\']', '')) >= 12,
  concat('line ', i + 3, ': ', substring_index(l, ' ', -size(split(l, ' ')) + 1)), null)), x -> x is not null), '\\n')"""


@query("x_reanchored")
def _(spark, d):
    """Citations of all lines of all documents, without their first words and two lines off, set right by the whole text. Tests compare with a scan of all lines."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.expr(_CITED).alias("cited"))
    moved = docs.select("doc_id", "cited", A.reanchored("cited", "text").alias("a"))
    n = F.when(F.coalesce("cited", F.lit("")) == "", 0).otherwise(F.size(F.split("cited", "\n")))
    right = F.size(F.filter("a.moves", lambda m: m["line"] == m["cited"] - 2))
    return moved.select("doc_id", n.alias("n_cited"), F.size("a.moves").alias("n_moved"), right.alias("n_two_back"), F.md5(F.col("a.text").cast("binary")).alias("text_md5"))


_SCRIPTS = r"(?is)<script[^>]*>(.*?)</script>"


def scripts(spark, d):
    """(page_id, code): all scripts of a page, one under the other."""
    return table(spark, d, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit(_SCRIPTS), 1), "\n").alias("code"))


@query("x_call_arguments", r"""
SELECT page_id, regexp_extract(c, '^(\w+)', 1) AS callee, 1 AS line, 0 AS n, regexp_extract(c, '\((.*)\)', 1) AS text, regexp_matches(c, '\([0-9]+\)') AS constant
FROM (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?is)<script[^>]*>(.*?)</script>', 1), '\w+\([^()]*\)')) AS c FROM pages)""")
def _(spark, d):
    """Arguments of all calls in the scripts of all pages; these scripts call on one line, without nesting."""
    code = scripts(spark, d)
    return C.arguments(code, L.tokens(code, "page_id", "code"), "page_id", "code").select("page_id", "callee", "line", "n", "text", "constant")


_HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)"


def programs(spark, d):
    """(page_id, code): the scripts of a page and a function for each link of its menu, which hands on what it gets, harmless if the address has a length divided by five."""
    links, n = F.col("links"), F.size("links")
    each = F.transform(links, lambda h, i: F.concat(F.lit("function go"), i, F.lit("(u) {\nvar v = "), F.when(F.length(h) % 5 == 0, "escape(u)").otherwise('u + "on"'), F.lit(";\n"), F.when(i == n - 1, "open(v)").otherwise(F.concat(F.lit("go"), i + 1, F.lit("(v)"))), F.lit(";\n}")))
    start = F.when(n > 0, "go0(location.search);").otherwise("open(location.search);")
    pages = table(spark, d, "pages").select("page_id", F.expr(_HREFS).alias("links"), F.array_join(F.regexp_extract_all("html", F.lit(_SCRIPTS), 1), ";").alias("script"))
    code = F.concat_ws("\n", F.regexp_replace("script", "\n", " "), F.when(n > 0, F.array_join(each, "\n")), start)
    return pages.select("page_id", code.alias("code"))


@query("x_script_flows", f"""
WITH p AS (SELECT page_id, {_HREFS} AS hs FROM pages),
q AS (SELECT page_id, len(hs) AS n FROM p WHERE len(list_filter(hs, lambda h: length(h) % 5 = 0)) = 0)
SELECT page_id, 'location.search' AS source, (2 + 4 * n)::INT AS source_line, 'open' AS sink, greatest(4 * n, 2)::INT AS sink_line, 'Path Traversal' AS label,
  (2 + 4 * n) || coalesce(nullif(',' || array_to_string(list_transform(range(n), lambda i: (2 + 4 * i) || ',' || (3 + 4 * i) || ',' || (4 + 4 * i)), ','), ','), '') AS lines FROM q""")
def _(spark, d):
    """Flows from the address of a page through the functions of its links to what they open."""
    found = C.flows(L.tokens(programs(spark, d), "page_id", "code"), "page_id", C.flow_rules(spark))
    return found.select("page_id", "source", "source_line", "sink", "sink_line", "label", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("x_argument_origins", f"""
WITH p AS (SELECT page_id, {_HREFS} AS hs, regexp_extract(html, '(?is)<script[^>]*>(.*?)</script>', 1) AS s FROM pages),
e AS (SELECT page_id, len(hs) AS n, unnest(hs) AS h, unnest(range(len(hs))) AS i FROM p)
SELECT page_id, regexp_extract(s, '(\\w+)\\([0-9]+\\)', 1) AS callee, 1 AS line, regexp_extract(s, '\\w+\\(([0-9]+)\\)', 1) AS text, 'literal' AS origin FROM p
UNION ALL SELECT page_id, CASE WHEN len(hs) > 0 THEN 'go0' ELSE 'open' END, (2 + 4 * len(hs))::INT, 'location.search', 'variable' FROM p
UNION ALL SELECT page_id, 'escape', (3 + 4 * i)::INT, 'u', 'variable' FROM e WHERE length(h) % 5 = 0
UNION ALL SELECT page_id, CASE WHEN i = n - 1 THEN 'open' ELSE 'go' || (i + 1) END, (4 + 4 * i)::INT, 'v', CASE WHEN length(h) % 5 = 0 THEN 'variable' ELSE 'built' END FROM e""")
def _(spark, d):
    """What the arguments of all calls come from, over two assignments at most."""
    code = programs(spark, d)
    return C.argument_origins(code, L.tokens(code, "page_id", "code"), "page_id", "code").select("page_id", "callee", "line", "text", "origin")


@query("x_derived_names", f"""
WITH p AS (SELECT page_id, {_HREFS} AS hs FROM pages),
e AS (SELECT page_id, unnest(hs) AS h, unnest(range(1, len(hs) + 1)) AS i FROM p),
stops AS (SELECT page_id, min(i) AS stop FROM e WHERE length(h) % 5 = 0 GROUP BY page_id)
SELECT page_id, 'a0' AS var, 1 AS line, 0 AS hop FROM p UNION ALL SELECT e.page_id, 'a' || i, (i + 1)::INT, i::INT FROM e LEFT JOIN stops s USING (page_id) WHERE i <= 2 AND i < coalesce(s.stop, 99999)""")
def _(spark, d):
    """Variables set from the address of a page, and from those, over two assignments at most: one for each link of its menu."""
    links = F.expr(_HREFS)
    each = F.transform(links, lambda h, i: F.concat(F.lit("var a"), i + 1, F.lit(" = "), F.when(F.length(h) % 5 == 0, '"none"').otherwise(F.concat(F.lit("a"), i, F.lit(' + "on"'))), F.lit(";")))
    code = table(spark, d, "pages").select("page_id", F.concat_ws("\n", F.lit("var a0 = location.href;"), F.array_join(each, "\n")).alias("code"))
    return C.derived(L.tokens(code, "page_id", "code"), "page_id", C.flow_rules(spark)).select("page_id", "var", "line", "hop")


@query("x_secret_rules", r"""
WITH hits AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b[\w-]*(?:secret|token|password|passwd|api[_-]?key)[\w-]*\s*[=:]\s*[''"]([^''"\s]{8,})[''"]', 1)) AS value FROM documents),
chars AS (SELECT DISTINCT value, unnest(string_split(value, '')) AS c, unnest(range(length(value))) AS i FROM hits),
bits AS (SELECT value, -sum(n / t * log2(n / t)) AS e FROM (SELECT value, c, count(*)::DOUBLE AS n, length(value)::DOUBLE AS t FROM chars GROUP BY value, c) GROUP BY value)
SELECT doc_id, 'assigned-secret' AS rule, value FROM hits JOIN bits USING (value) WHERE e >= 3 AND NOT regexp_matches(value, '(?i)example|changeme|placeholder')
UNION ALL SELECT doc_id, 'aws-access-key-id', unnest(regexp_extract_all(text, '\b((?:A3T[A-Z0-9]|AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16})\b', 1)) FROM documents
UNION ALL SELECT doc_id, 'bytes-literal-secret', unnest(regexp_extract_all(text, '(?i)\b[\w-]*(?:secret|token|password|passwd|api[_-]?key|credential|access[_-]?key|private[_-]?key)[\w-]*\s*=\s*b[''"]([^''"]{8,})[''"]', 1)) FROM documents
UNION ALL SELECT doc_id, 'json-web-token', unnest(regexp_extract_all(text, '\b(eyJ[\w-]{10,}\.eyJ[\w-]{10,}\.[\w-]{10,})', 1)) FROM documents
UNION ALL SELECT doc_id, 'private-key-block', unnest(regexp_extract_all(text, '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----')) FROM documents""")
def _(spark, d):
    """Secrets in all documents by rules that come as rows."""
    return R.scan(table(spark, d, "documents"), "doc_id", "text", R.secret_rules(spark)).select("doc_id", "rule", "value")


@query("x_rule_rows", """
WITH s AS (SELECT page_id, string_split(regexp_extract(html, '(?is)<script[^>]*>(.*?)</script>', 1), chr(10)) AS ls FROM pages)
SELECT page_id, 'menu-tracking' AS rule, 1 AS line, regexp_extract(ls[1], 'track\\([0-9]+\\)') AS value FROM s WHERE regexp_matches(ls[1], 'track\\([0-9]+\\)')
UNION ALL SELECT page_id, 'markup-in-string', 1, regexp_extract(ls[1], '"([^"]*<[^"]*)"', 1) FROM s WHERE regexp_matches(ls[1], '"([^"]*<[^"]*)"') AND NOT regexp_matches(ls[1], 'track\\([0-9]*[05]\\)')""")
def _(spark, d):
    """The danger rules and two more rows, over the scripts of all pages."""
    more = spark.createDataFrame([("menu-tracking", r"track\([0-9]+\)", ["track("], [], [], None, "", "low"), ("markup-in-string", r'"([^"]*<[^"]*)"', ["<"], [r"track\([0-9]*[05]\)"], [], None, "CWE-79", "low")], R.SCHEMA)
    return R.scan(scripts(spark, d), "page_id", "code", R.danger_rules(spark).union(more)).select("page_id", "rule", "line", "value")


def revisions(spark, d):
    """(a, b, lang, old, new): documents that begin with the same eight words as another one, beside the one of the smallest id among those."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    start = F.lower(F.regexp_extract("text", r"^\s*(\S+(?:\s+\S+){7})", 1))
    begun = docs.withColumn("start", F.md5(F.regexp_replace(start, r"\s+", " ").cast("binary"))).where(start != "")
    first = begun.groupBy("start").agg(F.min(F.struct("doc_id", "text")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = begun.join(first, "start").where("doc_id <> f.doc_id AND text <> f.text")
    return pairs.select(F.col("f.doc_id").alias("a"), F.col("doc_id").alias("b"), "lang", F.col("f.text").alias("old"), F.col("text").alias("new"))


@query("x_localized_fixes")
def _(spark, d):
    """Hints by line of what revisions of documents changed. Tests compare with a unified diff."""
    out = X.localized(revisions(spark, d), ["a", "b"], "old", "new")
    return out.select("a", "b", F.size("hints").alias("n_hints"), "needs_review", F.md5(F.array_join("hints", "\n").cast("binary")).alias("hints_md5"))


# words and evidence of the texts' languages, as rows
_WORDS = [("en", w) for w in ("the", "and", "to")] + [("de", w) for w in ("die", "und")] + [("fr", w) for w in ("le", "de")] + [("es", w) for w in ("el", "la")]
_PROOFS = [("en", True, r"\bthe\b.*\band\b"), ("en", False, r"\bthe\b"), ("de", True, r"\bdie\b"), ("fr", True, r"\b\d{6,}\b"), ("fr", False, r"\bune\b")]


@query("x_patch_gates")
def _(spark, d):
    """Gates of what revisions of documents changed, with the language as class and the first line of the new text as description."""
    pairs = revisions(spark, d).withColumn("about", F.split_part("new", F.lit("\n"), F.lit(1)))
    return X.gates(pairs, ["a", "b"], "old", "new", "lang", "about", spark.createDataFrame(_WORDS, "label string, word string"), spark.createDataFrame(_PROOFS, "label string, strong boolean, pattern string"))


_LINE_RULES = [("opens", r"\bopen\(", ["open("], [], [], None, "Path Traversal", ""), ("address", r"location\.search", ["location"], [], [], None, "Path Traversal", ""), ("joins", r'\+ "on"', ['"on"'], [], [], None, "Path Traversal", ""), ("starts", r"go0\(location", ["go0("], [], [], None, "", "")]


@query("x_merge_candidates", f"""
WITH p AS (SELECT page_id, {_HREFS} AS hs FROM pages),
q AS (SELECT page_id AS file, len(hs) AS n, len(list_filter(hs, lambda h: length(h) % 5 = 0)) AS clean FROM p)
SELECT file, 'open' AS first, 'flows+lines' AS tools, 3 AS n_members FROM q WHERE clean = 0
UNION ALL SELECT file, 'opens', 'lines', 1 FROM q WHERE clean > 0
UNION ALL SELECT file, 'address', 'lines', 1 FROM q WHERE clean > 0
UNION ALL SELECT file, 'joins', 'lines', n - clean FROM q WHERE n > clean
UNION ALL SELECT file, 'page', 'page', 1 FROM q WHERE clean > 0 OR n > clean""")
def _(spark, d):
    """Findings of three tools in the programs of all pages, merged: flows with source and sink, hits of line rules, and a mark of the page without a line."""
    code = programs(spark, d)
    none = lambda kind: F.lit(None).cast(kind)
    flow = C.flows(L.tokens(code, "page_id", "code"), "page_id", C.flow_rules(spark)).select(F.col("page_id").alias("file"), F.lit(0).alias("pos"), F.col("label").alias("type"), none("string").alias("rule"), F.lit("flows").alias("tool"), "source", "sink", "source_line", "sink_line")
    hits = R.scan(code, "page_id", "code", spark.createDataFrame(_LINE_RULES, R.SCHEMA)).where("label <> ''").select(F.col("page_id").alias("file"), (F.col("start") + 1).alias("pos"), F.col("label").alias("type"), "rule", F.lit("lines").alias("tool"), none("string").alias("source"), none("string").alias("sink"), none("int").alias("source_line"), F.col("line").alias("sink_line"))
    marks = code.select(F.col("page_id").alias("file"), F.lit(1 << 30).alias("pos"), F.lit("Path Traversal").alias("type"), F.lit("page").alias("rule"), F.lit("page").alias("tool"), none("string").alias("source"), none("string").alias("sink"), none("int").alias("source_line"), none("int").alias("sink_line"))
    found = flow.unionByName(hits).unionByName(marks).withColumns({"family": F.col("type"), "category": F.lit("taint")})
    merged = M.merge_findings(found)
    names = found.select("file", "pos", "rule").where("rule IS NOT NULL")
    return merged.join(names, ["file", "pos"], "left").select("file", F.coalesce("rule", "sink").alias("first"), "tools", F.size("members").alias("n_members"))


@query("x_windowed_context")
def _(spark, d):
    """Context of all documents around their first and middle lines under a budget of 600. Tests compare with a plain packing."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    n = F.size(F.split("text", "\n"))
    out = docs.select("doc_id", n.alias("n_lines"), T.windowed_context("text", F.array(F.lit(1), F.floor((n + 1) / 2).cast("int")), F.array(F.lit("")), 600).alias("context"))
    return out.select("doc_id", "n_lines", F.length("context").alias("n_chars"), F.regexp_count("context", F.lit("(?m)^# …… 省略")).alias("n_skipped"), F.md5(F.col("context").cast("binary")).alias("context_md5"))
