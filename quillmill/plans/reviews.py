"""Queries of the gates whose order is part of the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import reviews as V
from .registry import query, table


def _judged(spark, d):
    """Documents with labels: has_vulnerability stands for toxic."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.join(table(spark, d, "labels").select("doc_id", (F.coalesce("toxic", F.lit(0)) == 1).alias("says")), "doc_id")


_JUDGED = "j AS (SELECT doc_id, coalesce(d.text, '') AS t, coalesce(toxic, 0) = 1 AS says FROM documents d JOIN labels USING (doc_id))"


@query("g_style", r"""WITH t AS (SELECT 'd' || doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, coalesce(text, '') FROM conversations),
s AS (SELECT id, t, list_filter(string_split(split_part(t, '```json', 1), chr(10)), lambda x: regexp_matches(x, '^\s*\d+\.')) AS steps, len(regexp_extract_all(t, '[A-Za-z]{2,}')) AS words, length(t) - length(regexp_replace(t, '[一-鿿]', '', 'g')) AS han FROM t)
SELECT id, CASE WHEN length(t) > 6000 THEN 'too_long' WHEN words > 60 AND words > 3 * greatest(han, 1) THEN 'english' WHEN regexp_matches(t, '\b(Actually|Hmm+|Let me|Wait,|sorry|I''ll|I''ve|Okay,|Ah,)\b') THEN 'monologue'
  WHEN contains(t, '安全模式白名单') OR contains(t, '命中安全模式') THEN 'meta_leak' WHEN len(steps) = 0 THEN 'no_steps' END AS reason FROM s""")
def _(spark, d):
    """Why whole texts and turns are refused; none has a step said to be vague."""
    texts = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").union(table(spark, d, "conversations").select(F.concat_ws("-", F.concat(F.lit("c"), "conv_id"), "turn"), "text"))
    return texts.select("id", V.style_reason("text").alias("reason"))


_TYPE = "CASE doc_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'CWE-89' WHEN 2 THEN 'plain' WHEN 3 THEN 'CWE-79/80' ELSE 'no cwe-20' END"
_RISK = "CASE doc_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'n/a' ELSE 'None' END"
_EXPECT = "(says OR doc_id % 7 = 0)"


@query("g_contract", f"""WITH {_JUDGED}, v AS (SELECT doc_id, says, {_EXPECT} AS e, {_TYPE} AS vt, {_RISK} AS risk, list_transform(regexp_extract_all(to_json(t)::VARCHAR || ' line ' || doc_id % 9, '(?i)line\\s*([0-9]+)', 1), lambda x: x::DOUBLE) AS cited FROM j)
SELECT doc_id, CASE WHEN says <> e THEN 'direction' WHEN risk = 'n/a' AND e THEN 'bad_risk' WHEN NOT e AND regexp_matches(vt, '(?i)cwe') THEN 'safe_with_class' WHEN e AND NOT contains(vt, 'CWE') THEN 'no_class'
  WHEN e AND len(list_filter(cited, lambda n: n < 1 OR n > 5)) > 0 THEN 'line_out_of_range' END AS reason,
  CASE WHEN risk = 'n/a' AND NOT e THEN 'None' ELSE risk END AS risk_level, CASE WHEN NOT e AND vt = 'plain' THEN 'none' WHEN e AND vt LIKE 'CWE-79%' THEN 'CWE-79' ELSE vt END AS vulnerability_type FROM v""")
def _(spark, d):
    """Verdicts whose explanation is a document's whole text, held against three lines of code."""
    fields = [F.col("says").alias("has_vulnerability"), F.expr(_TYPE).alias("vulnerability_type"), F.expr(_RISK).alias("risk_level"), F.lit("a").alias("source"), F.lit("b").alias("sink"), F.col("text").alias("explanation"), F.concat(F.lit("line "), F.col("doc_id") % 9).alias("fix_suggestion")]
    v = _judged(spark, d).select("doc_id", F.to_json(F.struct(*fields)).alias("obj"), F.expr(_EXPECT).alias("e"), F.lit("1| a\n2| b\n3| c").alias("code"))
    return v.select("doc_id", V.contract("obj", "e", "code").alias("v")).select("doc_id", "v.*")


@query("g_sections")
def _(spark, d):
    """Verdicts with whole texts as reasoning; tests hold the check against golden cases."""
    fields = [F.col("says").alias("has_vulnerability"), F.expr(_TYPE).alias("vulnerability_type"), F.expr(_RISK).alias("risk_level"), F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H").alias("cvss_vector"), (F.col("doc_id") % 13).alias("cvss_score")]
    fields += [F.lit("a").alias("source"), F.lit("b").alias("sink"), F.lit("c").alias("explanation"), F.lit("d").alias("fix_suggestion")]
    v = _judged(spark, d).select("doc_id", F.to_json(F.struct(*fields)).alias("obj"), "text", F.expr(_EXPECT).alias("e"))
    return v.select("doc_id", V.sections("obj", "text", "e").alias("v")).select("doc_id", "v.*")


_OUTCOME = "CASE WHEN says AND doc_id % 7 <> 0 THEN 'FP' WHEN says THEN 'TP' WHEN doc_id % 7 = 0 THEN 'FN' ELSE 'TN' END"
_CLASS = "CASE doc_id % 4 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-79' WHEN 2 THEN '' END"


@query("g_output_tags", f"""WITH {_JUDGED}, v AS (SELECT *, doc_id % 7 = 0 AS present, {_OUTCOME} AS outcome, {_CLASS} AS cls, lower(split_part(t, '```json', 1)) AS body, substring(t, length(t) // 3 + 1, 80) AS piece FROM j)
SELECT doc_id, unnest(list_filter([CASE WHEN outcome = 'TP' AND cls IS DISTINCT FROM 'CWE-89' THEN 'cwe_mismatch' END, CASE WHEN length(t) < 200 THEN 'too_short' END, CASE WHEN length(t) > 4000 THEN 'too_long' END,
  CASE WHEN NOT contains(t, '```json') AND NOT contains(t, '"has_vulnerability"') THEN 'no_json_block' END, CASE WHEN says AND regexp_matches(body, '未发现漏洞|不存在漏洞|代码是安全的|没有漏洞|安全代码') OR NOT says AND regexp_matches(body, '存在漏洞|存在安全漏洞|这里存在') THEN 'cot_json_inconsistent' END,
  CASE WHEN length(t) > 500 AND len(string_split(t, piece)) > 2 THEN 'repetition' END, CASE WHEN NOT present AND says AND cls <> '' THEN 'fp_with_cwe' END], lambda x: x IS NOT NULL)) AS tag FROM v""")
def _(spark, d):
    """What is wrong with whole texts taken for outputs."""
    v = _judged(spark, d).withColumns({"present": F.col("doc_id") % 7 == 0, "outcome": F.expr(_OUTCOME), "cls": F.expr(_CLASS), "want": F.array(F.lit("CWE-89"))})
    return v.select("doc_id", F.explode(V.output_tags("text", "says", "outcome", "present", "says", "cls", "want")).alias("tag"))


@query("g_reward_parts", f"""WITH {_JUDGED}, v AS (SELECT doc_id, says, doc_id % 7 = 0 AS e, length(CASE WHEN strpos(t, '```json') > 1 THEN left(t, strpos(t, '```json') - 1) ELSE t END) // 3 <= 300 AS short, contains(t, 'the') OR contains(t, 'que') AS shown, doc_id % 4 = 0 AS same FROM j)
SELECT doc_id, CASE WHEN says AND e THEN 'TP' WHEN says THEN 'FP' WHEN e THEN 'FN' ELSE 'TN' END AS outcome,
  round(0.1::DOUBLE + CASE WHEN says = e THEN 0.5::DOUBLE WHEN e THEN -0.3::DOUBLE ELSE -0.5::DOUBLE END + CASE WHEN says AND e AND same THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN says AND e AND shown THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN says = e AND short THEN 0.1::DOUBLE ELSE 0 END, 4) AS total FROM v""")
def _(spark, d):
    """Rewards of whole texts taken for outputs and code."""
    v = _judged(spark, d).withColumns({"e": F.col("doc_id") % 7 == 0, "cls": F.expr(_CLASS)})
    return v.select("doc_id", V.reward("text", "says", "cls", F.lit("line 2: the que"), "e", F.lit("cwe89"), "text").alias("r")).select("doc_id", "r.outcome", "r.total")


_ALERT = {"category": "CASE user_id % 5 WHEN 0 THEN 'secret' WHEN 1 THEN 'sast' WHEN 2 THEN 'iac' WHEN 3 THEN 'sca' ELSE 'taint' END", "owned": "event_type = 'click'", "secret_like": "event_type = 'purchase'", "strong": "user_id % 2 = 0"}
_ALERTS = ", ".join(f"{e} AS {k}" for k, e in _ALERT.items())


@query("x_alert_routes", f"""WITH a AS (SELECT {_ALERTS} FROM events), r AS (SELECT category AS was, CASE WHEN category = 'secret' THEN if(strong, 'secret/direct', 'sast/weak_secret') WHEN category IN ('sca', 'taint') OR owned THEN category || '/owned'
  WHEN NOT secret_like THEN category || '/ownerless' WHEN strong THEN 'secret/strong_secret' ELSE category || '/judged' END AS route FROM a) SELECT was, route, count(*) AS n FROM r GROUP BY was, route""")
def _(spark, d):
    """Where alerts go, counted."""
    a = table(spark, d, "events").select(*[F.expr(e).alias(k) for k, e in _ALERT.items()])
    r = a.select(F.col("category").alias("was"), V.route("category", "owned", "secret_like", "strong").alias("r"))
    return r.groupBy("was", F.concat_ws("/", "r.category", "r.reason").alias("route")).agg(F.count(F.lit(1)).alias("n"))


_SPOTS = "regexp_count(text, '[Tt]he') % 4"


@query("r_review_tiers", """WITH v AS (SELECT doc_id, length(coalesce(text, '')) % 25 AS risk, len(regexp_extract_all(coalesce(text, ''), '[Tt]he')) % 4 AS spots FROM documents), w AS (SELECT *, ('0x' || left(md5('tier|' || doc_id), 8))::BIGINT / 4294967296.0::DOUBLE < 0.1::DOUBLE AS drawn FROM v)
SELECT doc_id, CASE WHEN spots > 0 AND (risk >= 12 OR spots >= 2) THEN 'A' WHEN spots > 0 OR risk >= 12 OR drawn THEN 'B' ELSE 'C' END AS tier, CASE WHEN spots > 0 AND (risk >= 12 OR spots >= 2) THEN 3 WHEN spots > 0 OR risk >= 12 OR drawn THEN 1 ELSE 0 END AS votes FROM w""")
def _(spark, d):
    """Tiers of documents by numbers that their whole texts give."""
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    v = t.select("doc_id", (F.length("text") % 25).alias("risk"), F.expr(_SPOTS).alias("spots"))
    return v.select("doc_id", E.review_tier("risk", "spots", "spots", "doc_id").alias("v")).select("doc_id", "v.tier", "v.votes")


@query("j_rule_class", "WITH f AS (SELECT CASE user_id % 3 WHEN 0 THEN 'os_command' WHEN 1 THEN 'weak_hash' ELSE event_type END AS rule FROM events) SELECT rule, CASE rule WHEN 'os_command' THEN 'CWE-78' WHEN 'weak_hash' THEN 'CWE-327' END AS cwe, count(*) AS n FROM f GROUP BY ALL")
def _(spark, d):
    f = table(spark, d, "events").select(F.expr("CASE user_id % 3 WHEN 0 THEN 'os_command' WHEN 1 THEN 'weak_hash' ELSE event_type END").alias("rule"))
    return E.with_class(f.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))).select("rule", "cwe", "n")


@query("v_random_context", "SELECT doc_id FROM documents ORDER BY md5('control|' || doc_id), doc_id LIMIT 20")
def _(spark, d):
    """Twenty documents whatever the query, the control of a retrieval."""
    return E.random_context(table(spark, d, "documents").select("doc_id"), "doc_id", 20, "control")


@query("v_padded_context", "SELECT doc_id, md5(left(repeat('nothing to see here' || chr(10), (n_chars // 20 + 2)::INT), n_chars::INT)) AS context_md5 FROM (SELECT doc_id, length(coalesce(text, '')) AS n_chars FROM documents)")
def _(spark, d):
    """A text without a bearing, as long as each document."""
    t = table(spark, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return t.select("doc_id", F.md5(E.padded("nothing to see here", "n").cast("binary")).alias("context_md5"))


@query("x_evidence_gate")
def _(spark, d):
    """Gates of findings in pages' whole scripts and markup; tests hold the gate against golden cases."""
    p = table(spark, d, "pages").select("page_id", E.evidence_gate("html", F.lit("js"), F.lit("XSS"), F.lit(5), F.lit(True)).alias("gate"), E.line_marks("html").alias("m"))
    return p.select("page_id", "gate", F.size("m").alias("n_marks"), F.size(F.filter("m", lambda x: x["declared"] != x["actual"])).alias("n_wrong"))
