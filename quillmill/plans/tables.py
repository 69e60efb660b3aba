"""Queries of sources and sinks, streams, and plain relational work on the star schema."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import readers as S
from ..sources import windows as N
from ..streaming import approval as P
from ..streaming import streams as W
from .registry import query, table

# --- sources and sinks -----------------------------------------------------------------------------


@query("src_jsonl", "SELECT doc_id, md5(text) AS h, lang FROM documents")
def _(spark, d):
    """Documents through JSON lines and back."""
    path = S.scratch(spark, "jsonl")
    S.write_jsonl(table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return S.read_jsonl(spark, path, "doc_id bigint, text string, lang string").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), "lang")


@query("src_jsonl_bad", "SELECT count(*) FILTER (doc_id % 7 <> 0) AS good, count(*) FILTER (doc_id % 7 = 0) AS bad FROM documents")
def _(spark, d):
    """Every seventh line is cut off: bad lines are kept and counted."""
    path = S.scratch(spark, "bad")
    line = F.to_json(F.struct("doc_id", "lang"))
    table(spark, d, "documents").select(F.when(F.col("doc_id") % 7 == 0, F.expr("left(to_json(struct(doc_id, lang)), 9)")).otherwise(line).alias("value")).write.text(path)
    rows = S.read_jsonl(spark, path, "doc_id bigint, lang string", keep_bad=True)
    return rows.agg(F.count_if(F.col(S.CORRUPT).isNull()).alias("good"), F.count_if(F.col(S.CORRUPT).isNotNull()).alias("bad"))


@query("src_event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("src_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return S.not_done(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("src_source_caps", "SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE CASE source WHEN 'src1' THEN rn <= 5 WHEN 'src2' THEN rn <= 10 ELSE true END")
def _(spark, d):
    return S.source_caps(table(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"], {"src1": 5, "src2": 10}).select("doc_id")


@query("src_sarif", "SELECT sha256('dirt|' || source || '|' || doc_id) AS fingerprint, count(*) AS n FROM documents WHERE doc_id % 9 = 0 GROUP BY 1")
def _(spark, d):
    f = table(spark, d, "documents").where("doc_id % 9 = 0").select(F.lit("dirt").alias("rule"), F.lit("high").alias("severity"), F.col("source").alias("path"), F.col("doc_id").alias("line"), F.lit("m").alias("message"))
    return S.sarif_results(f).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


@query("src_union_sources", "SELECT kind, count(*) AS n FROM (SELECT 'doc' AS kind FROM documents UNION ALL SELECT 'page' FROM pages UNION ALL SELECT 'bench' FROM benchmark) GROUP BY kind")
def _(spark, d):
    parts = [table(spark, d, t).select(F.col(k).alias("id"), F.lit(n).alias("kind")) for t, k, n in (("documents", "doc_id", "doc"), ("pages", "page_id", "page"), ("benchmark", "item_id", "bench"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- streams ---------------------------------------------------------------------------------------


def _events(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d).withColumn("at", F.col("ts").cast("timestamp"))


@query("st_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    """Hourly counts of a table read as a batch; st_stream_windows runs the same as a stream."""
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("st_stream_windows")
def _(spark, d):
    """Hourly counts by a stream in append mode: the windows the watermark has closed."""
    return W.run_to_table(W.tumbling(_events(spark, d), "at", "1 hour", "10 minutes", ["event_type"]), S.scratch(spark, "windows"))


@query("st_stream_fresh", "SELECT event_id FROM events")
def _(spark, d):
    """Events of a stream without those seen before."""
    return W.run_to_table(W.fresh(_events(spark, d), "event_id", "at", "1 day").select("event_id"), S.scratch(spark, "fresh"))


@query("src_windows", "SELECT event_id, strftime(date_trunc('day', ts), '%Y%m%dT000000') AS window FROM events")
def _(spark, d):
    """All events taken over day by day: a run that stops after five days, and one that resumes."""
    events = table(spark, d, "events")
    path = S.scratch(spark, "taken")
    N.take_over(events, "ts", timedelta(days=1), path, most=5)
    N.take_over(events, "ts", timedelta(days=1), path)
    return N.taken(events, path).select("event_id", "window")


@query("st_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def _(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def _evidence(e):
    return e.select(F.col("event_type").alias("rule"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), (F.col("value") > 5).alias("ok"), F.col("event_id").alias("seq"))


@query("st_evidence", """WITH e AS (SELECT event_type AS rule, user_id AS file, value > 5 AS ok, event_id AS seq FROM events), l AS (SELECT rule, max(seq) FILTER (NOT ok) AS last, count(*) FILTER (NOT ok)::INT AS rejected FROM e GROUP BY rule),
n AS (SELECT l.rule, rejected, count(DISTINCT file) FILTER (ok AND (last IS NULL OR seq > last))::INT AS files FROM l JOIN e USING (rule) GROUP BY ALL) SELECT rule, files AS confirmed, rejected, files, files >= 2 AS ready FROM n""")
def _(spark, d):
    return W.evidence_batch(_evidence(table(spark, d, "events")))


def _claims(e):
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("rule"), F.col("event_type").alias("file"), (F.col("value") > 1).alias("ok"), F.col("event_id").alias("seq"), F.col("at"))


@query("st_approval", """
WITH e AS (SELECT 'u' || user_id AS rule, event_type AS file, value > 1 AS ok, event_id AS seq, ts AS t, (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS stop FROM events),
c AS (SELECT * FROM e WHERE t <= stop),
l AS (SELECT rule, max((t, seq)) FILTER (NOT ok) AS last, count(*) FILTER (NOT ok)::INT AS rejected, any_value(stop) AS stop FROM c GROUP BY rule),
f AS (SELECT c.rule, c.file, min(c.t) AS t FROM c JOIN l USING (rule) WHERE c.ok AND (l.last IS NULL OR (c.t, c.seq) > l.last) GROUP BY c.rule, c.file),
n AS (SELECT rule, count(*)::INT AS files, list_sort(list(t))[3] AS reached FROM f GROUP BY rule)
SELECT l.rule, l.rejected, coalesce(n.files, 0) AS files, coalesce(n.reached + INTERVAL 12 HOUR <= l.stop, false) AS approved FROM l LEFT JOIN n USING (rule)""")
def _(spark, d):
    """Users whom three kinds of events have confirmed since the last rejection, approved after twelve hours without one: a stream over all events, up to its watermark."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = W.run_to_table(P.approvals(_claims(_events(spark, d)), 3, timedelta(hours=12), "1 hour"), S.scratch(spark, "approval"))
    finally:
        spark.conf.set(name, old)
    return P.last_rows(found)


@query("st_asof", """SELECT a.event_id, b.event_id AS before_id FROM (SELECT * FROM events WHERE event_id % 10 = 0) a ASOF LEFT JOIN (SELECT * FROM events WHERE event_id % 10 <> 0) b ON a.user_id = b.user_id AND a.ts > b.ts""")
def _(spark, d):
    """The last earlier event of the same key: a union and one window, no join."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 10 == 0).alias("q"))
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.max(F.when(~F.col("q"), F.struct("ts", "event_id"))).over(w)
    return e.withColumn("b", seen).where("q").select("event_id", F.col("b.event_id").alias("before_id"))


# --- relational ------------------------------------------------------------------------------------


@query("q_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-01' GROUP BY ALL""")
def _(spark, d):
    x = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-01 00:00:00'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("q_shipping_priority", """SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def _(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_semi")
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))  # noqa: E741
    return o.join(l, "o_orderkey").groupBy("o_orderkey").agg(F.round(F.sum("r"), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("q_region_revenue", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def _(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.expr("n_regionkey = r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = table(spark, d, "supplier").join(n, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    return table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_discount").join(s, "l_suppkey").groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("q_discount_revenue", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def _(spark, d):
    return table(spark, d, "lineitem").where("l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("q_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("q_customer_rank", "SELECT c_custkey, c_nationkey, rank FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def _(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("q_no_orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("q_part_sizes", "SELECT p_brand, count(DISTINCT p_size) AS sizes, max(p_retailprice) AS dearest FROM part GROUP BY p_brand")
def _(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.countDistinct("p_size").alias("sizes"), F.max("p_retailprice").alias("dearest"))
