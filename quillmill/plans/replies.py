"""Queries of class labels, replies, leaks by both ends of a fragment, hard samples and monitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import replies as R
from ..operators import leaks as K
from ..operators import metrics as M
from .checks import _REPLY
from .metrics import WITH, records
from .registry import query, table

# raw class names and the labels they must get
GOLDEN = [
    ("CWE-29 SQL注入", "CWE-89 SQL Injection"), ("CWE-89 sql injection", "CWE-89 SQL Injection"), ("命令注入", "CWE-78 Command Injection"), ("cmdi", "CWE-78 Command Injection"),
    ("logical bug", "logical bug"), ("cmdispatch", "cmdispatch"), ("XSS", "CWE-79 Cross-Site Scripting"), ("NoSQL injection", "CWE-943 Improper Neutralization of Special Elements in Data Query Logic"),
    ("CSRF", "CWE-352 Cross-Site Request Forgery"), ("  Path Traversal ", "CWE-22 Path Traversal"), ("none", "none"), ("", "none"), ("CWE-999 rare thing", "CWE-999 rare thing"), ("use LDAP", "CWE-90 Improper Neutralization of Special Elements used in an LDAP Statement"),
]
_RAW = "element_at(array({}), CAST(doc_id % {} AS INT) + 1)".format(", ".join(f"'{r}'" for r, _ in GOLDEN), len(GOLDEN))
_VALUES = ", ".join(f"({i}, '{r}', '{w}')" for i, (r, w) in enumerate(GOLDEN))


@query("fn_class_label", f"SELECT doc_id, g.want AS label FROM documents JOIN (VALUES {_VALUES}) AS g(i, raw, want) ON doc_id % {len(GOLDEN)} = g.i")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", L.class_label(F.expr(_RAW)).alias("label"))


@query("fn_class_label_texts", "SELECT doc_id, CASE WHEN trim(coalesce(text, ''), ' ') IN ('', 'none') THEN 'none' WHEN regexp_matches(lower(text), 'nosql|no sql|no-sql') THEN 'CWE-943' WHEN contains(lower(text), 'sql') THEN 'CWE-89' ELSE 'other' END AS class FROM documents")
def _(spark, d):
    """Which of the first two classes whole texts name."""
    label = F.col("label")
    return table(spark, d, "documents").select("doc_id", L.class_label("text").alias("label")).select("doc_id", F.when(label == "none", "none").when(label.isin(L.LABELS[0][1], L.LABELS[1][1]), F.regexp_extract(label, "^CWE-[0-9]+", 0)).otherwise("other").alias("class"))


@query("fn_class_evidence", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'CWE-352 Cross-Site Request Forgery' WHEN 1 THEN 'CWE-639 other' WHEN 2 THEN 'CWE-1321 Improperly Controlled Modification of Object Prototype Attributes (''Prototype Pollution'')'
  WHEN 3 THEN 'CWE-89 SQL Injection' WHEN 4 THEN 'B608' ELSE 'none' END AS label FROM documents""")
def _(spark, d):
    raw = F.expr("element_at(array('B608', 'CWE-639 other', 'CWE-912 proxy', 'sql here', 'B608', CAST(NULL AS STRING)), CAST(doc_id % 6 AS INT) + 1)")
    why = F.expr("element_at(array('a CSRF token is missing', 'sql', 'sets __proto__', 'xss', 'plain words', ''), CAST(doc_id % 6 AS INT) + 1)")
    return table(spark, d, "documents").select("doc_id", L.class_with_evidence(raw, why).alias("label"))


@query("fn_class_family", """SELECT event_id, a.n AS reported, a.m AS expected, a.n = a.m OR (least(a.n, a.m), greatest(a.n, a.m)) IN ((94, 917), (94, 1336), (79, 80), (94, 95)) AS same
  FROM (SELECT event_id, user_id::INT AS n, regexp_extract(props, '[0-9]+')::INT AS m FROM events) AS a""")
def _(spark, d):
    """Whether the class an event's user stands for and the one its property names are one family, for all events."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("int").alias("reported"), F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("expected"))
    name = lambda c: F.concat(F.lit("CWE-"), F.col(c).cast("string"))
    return e.select("event_id", "reported", "expected", L.same_family(name("reported"), name("expected")).alias("same"))


# the objects of these tables hold no further ones
_OBJECTS = " UNION ALL ".join(f"SELECT {i} AS id, unnest(regexp_extract_all({c}, '\\{{[^{{}}]*\\}}')) AS object FROM {t}" for i, c, t in (("'d' || doc_id", "text", "documents"), ("'c-' || conv_id || '-' || turn", "text", "conversations"), ("'p' || page_id", "html", "pages"), ("'e' || event_id", "props", "events")))


@query("fn_json_objects", _OBJECTS)
def _(spark, d):
    """Objects in braces in whole texts, turns, pages and the properties of events. Tests compare with a scan by character."""
    texts = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").union(table(spark, d, "conversations").select(F.concat_ws("-", F.lit("c"), "conv_id", "turn"), "text"))
    texts = texts.union(table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id"), "html")).union(table(spark, d, "events").select(F.concat(F.lit("e"), "event_id"), "props"))
    return texts.select("id", F.explode(R.json_objects("text")).alias("object"))


@query("fn_triage_verdict", """SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN CASE doc_id % 5 WHEN 0 THEN 'false' WHEN 4 THEN 'maybe' ELSE 'true' END END AS is_confirmed,
  CASE WHEN doc_id % 11 <> 0 THEN CASE doc_id % 6 WHEN 0 THEN '代码安全' WHEN 1 THEN '攻击者可以读' ELSE 'plain' END END AS reason FROM documents""")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", R.triage_verdict(F.expr(_REPLY)).alias("v"))
    return t.select("doc_id", "v.is_confirmed", "v.reason")


@query("j_front_back", """SELECT DISTINCT f.doc_id, b.item_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) f JOIN benchmark b
  ON length(f.line) >= 40 AND contains(b.text, left(f.line, 40)) AND contains(b.text, right(f.line, 40))""")
def _(spark, d):
    """Documents with a line whose first and last 40 characters both stand in one benchmark text."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return K.both_ends(lines, table(spark, d, "benchmark"), "line", "text", "item_id", 40).select("doc_id", "item_id").distinct()


@query("r_hard_samples", f"""{WITH}, t AS (SELECT doc_id, unnest(list_filter([CASE WHEN predicted IS NOT NULL AND expected AND NOT predicted THEN 'fn' END, CASE WHEN NOT expected AND predicted THEN 'fp' END,
  CASE WHEN expected AND predicted AND len(list_intersect(model_cwes, expected_cwes)) = 0 THEN 'class_mismatch' END, CASE WHEN elapsed > 10 THEN 'slow' END], lambda x: x IS NOT NULL)) AS kind FROM e) SELECT doc_id, kind FROM t""")
def _(spark, d):
    return M.hard_samples(records(spark, d), 10.0).select("doc_id", "kind")


@query("m_recall_monitor", """WITH c AS (SELECT count(*) FILTER (user_id % 3 = 0) AS rn, count(*) FILTER (user_id % 3 = 0 AND event_type = 'purchase') AS rh, count(*) FILTER (user_id % 3 = 1) AS an, count(*) FILTER (user_id % 3 = 1 AND event_type = 'purchase') AS ah,
  count(*) FILTER (user_id % 3 = 2) AS bn, count(*) FILTER (user_id % 3 = 2 AND event_type = 'purchase') AS bh FROM events)
SELECT rn AS n_random, rh AS hits_random, round(rh::DOUBLE / nullif(rn, 0), 4) AS miss_rate,
  round(greatest(0, (rh::DOUBLE / rn + 1.96::DOUBLE * 1.96 / (2 * rn) - 1.96::DOUBLE * sqrt(rh::DOUBLE / rn * (1 - rh::DOUBLE / rn) / rn + 1.96::DOUBLE * 1.96 / (4.0::DOUBLE * rn * rn))) / (1 + 1.96::DOUBLE * 1.96 / rn)), 4) AS low,
  round(least(1, (rh::DOUBLE / rn + 1.96::DOUBLE * 1.96 / (2 * rn) + 1.96::DOUBLE * sqrt(rh::DOUBLE / rn * (1 - rh::DOUBLE / rn) / rn + 1.96::DOUBLE * 1.96 / (4.0::DOUBLE * rn * rn))) / (1 + 1.96::DOUBLE * 1.96 / rn)), 4) AS high,
  round(ah::DOUBLE / nullif(an, 0), 4) AS tier_a_hit_rate, round(bh::DOUBLE / nullif(bn, 0), 4) AS tier_b_hit_rate FROM c""")
def _(spark, d):
    layer = F.element_at(F.array(F.lit("random"), F.lit("tier_a"), F.lit("tier_b")), (F.col("user_id") % 3 + 1).cast("int"))
    return M.recall_monitor(table(spark, d, "events").select(layer.alias("layer"), (F.col("event_type") == "purchase").alias("hit")))


@query("s_bootstrap_rates")
def _(spark, d):
    """Share of toxic documents by language with an interval from resampling; tests hold it against single draws."""
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return M.bootstrap_rates(t, ["lang"], F.col("toxic") == 1)
