"""Registered queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clusters as _centroids
from . import exact_dedup as _exact
from . import html_main_text as _html
from . import language_id as _lid
from . import mixing as _mixing
from . import ngram_join as _ngrams
from . import passage_dedup as _passages
from . import piece_sampling as _pieces
from . import quality_rules as _rules
from . import simhash_pivots as _pivots
from . import spelling_variants as _spelling
from . import token_store as _store
from . import toxicity as _tox
from .common import new_path, table


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed so that every source is expected to give as many rows."""
    out = _mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "copy", "n_copies", "shuffle_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


OP1_SQL = """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM sizes) / ((SELECT count(*) FROM sizes) * n::DOUBLE) AS rate FROM sizes),
chunks AS (SELECT source, greatest(1, ceil(rate / 16.0))::INT AS c, rate / greatest(1, ceil(rate / 16.0)) AS mean FROM rates),
pmf AS (SELECT source, k, exp(k * ln(mean) - mean - lgamma(k + 1)) AS p FROM chunks, range(0, 73) AS t(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS q FROM pmf),
draws AS (SELECT d.doc_id, d.source, d.text, t.i, ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '') || '|' || t.i), 1, 13))::BIGINT / 4503599627370496.0 AS u
          FROM documents d JOIN chunks c ON d.source IS NOT DISTINCT FROM c.source, range(1, c.c + 1) AS t(i)),
counts AS (SELECT r.doc_id, r.source, any_value(r.text) AS text, count(q.k) AS n FROM draws r LEFT JOIN cdf q ON q.source IS NOT DISTINCT FROM r.source AND q.q <= r.u AND q.k < 72 GROUP BY r.doc_id, r.source)
SELECT doc_id, source, t.c::INT AS copy, n::INT AS n_copies, md5('mix-1|deal|' || coalesce(doc_id::VARCHAR, '') || '|' || t.c) AS shuffle_key, md5(coalesce(text, '')) AS text_md5
FROM counts, range(0, n) AS t(c)
"""


def op2_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled subword segmentations of all documents, decoded again."""
    return _pieces.digests(table(spark, sf_dir, "documents"))


def op3_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of 0.9 or more of their 3-word shingles."""
    found = _ngrams.similarity_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def near_duplicate_sql(k: int, num: int, den: int, docs: str = "documents") -> str:
    """WITH clauses up to comp (doc_id, n_shingles, component_id)."""
    leads = " || ' ' || ".join(f"lead(w, {j}) OVER p" for j in range(1, k))
    return rf"""
  nd_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {docs}),
  nd_pos AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM nd_words WHERE len(ws) >= {k}),
  nd_grams AS (SELECT doc_id, w || ' ' || {leads} AS g FROM nd_pos WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
  nd_sets AS (SELECT DISTINCT doc_id, g FROM nd_grams WHERE g IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM nd_words WHERE len(ws) BETWEEN 1 AND {k - 1}),
  nd_sizes AS (SELECT doc_id, count(*) AS n FROM nd_sets GROUP BY doc_id),
  nd_shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM nd_sets a JOIN nd_sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  nd_links AS (SELECT a, b FROM nd_shared JOIN nd_sizes x ON x.doc_id = a JOIN nd_sizes y ON y.doc_id = b WHERE {den} * c >= {num} * (x.n + y.n - c)),
  nd_both AS (SELECT a, b FROM nd_links UNION ALL SELECT b, a FROM nd_links),
  nd_reach(d, r) AS (SELECT a, b FROM nd_both UNION SELECT q.d, e.b FROM nd_reach q JOIN nd_both e ON e.a = q.r),
  comp AS (SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(r) FROM nd_reach WHERE nd_reach.d = d.doc_id), d.doc_id)) AS component_id FROM {docs} d LEFT JOIN nd_sizes s ON s.doc_id = d.doc_id)"""


OP3_SQL = "WITH RECURSIVE " + near_duplicate_sql(3, 90, 100).replace("\\\\", "\\") + " SELECT doc_id, n_shingles, component_id FROM comp"


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages in all documents, and those that go: the first copy stays."""
    return _passages.per_document(table(spark, sf_dir, "documents")).drop("rid")


def op5_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among documents; the copy with the largest doc_id stays."""
    return _exact.exact_groups(table(spark, sf_dir, "documents")).drop("rid")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to a store and read back from it."""
    path = new_path(spark, "tokens")
    _store.write_store(table(spark, sf_dir, "documents"), path, _store.tokenizer_path())
    return _store.read_store(spark, path, _store.crc32, "bigint").select("doc_id", "start", "n_tokens", F.col("value").alias("ids_crc32"))


def op7_byte_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a network trained on those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    langs, model = _lid.fit(docs)
    return _lid.predict(docs, langs, model).select("doc_id", _lid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a network trained on labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = _tox.fit(docs, table(spark, sf_dir, "labels"))
    out = _tox.score(docs, model)
    return out.select("doc_id", _tox.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return _html.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdicts with thresholds per language and source."""
    out = _rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH words AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM words),
grams AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS g FROM pos WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams WHERE g IS NOT NULL) WHERE n >= 2),
covered AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(c.n, 0) AS n_repeat_words
  FROM words LEFT JOIN covered c USING (doc_id)),
rows_ AS (SELECT doc_id, lang, source, n_words, word_chars, n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM counts),
metrics AS (
  SELECT doc_id, lang, source, base_failed, 'symbol_ppm' AS metric, n_symbols * 1000000 // greatest(word_chars, 1) AS v FROM rows_
  UNION ALL SELECT doc_id, lang, source, base_failed, 'dup_line_ppm', n_dup_lines * 1000000 // greatest(n_lines, 1) FROM rows_
  UNION ALL SELECT doc_id, lang, source, base_failed, 'repeat_ppm', n_repeat_words * 1000000 // greatest(n_words, 1) FROM rows_
  UNION ALL SELECT doc_id, lang, source, base_failed, 'word_len', word_chars * 1000 // greatest(n_words, 1) FROM rows_),
bucketed AS (SELECT *, CASE WHEN v <= 0 THEN 0 ELSE 1 + floor(round(ln(v::DOUBLE) / 0.019802627296179712, 9))::INT END AS b FROM metrics WHERE NOT base_failed),
sketch AS (
  SELECT 0 AS lvl, lang, source, metric, b, count(*) AS n FROM bucketed GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, metric, b, count(*) FROM bucketed GROUP BY lang, metric, b
  UNION ALL SELECT 2, NULL, NULL, metric, b, count(*) FROM bucketed GROUP BY metric, b),
upto AS (SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, metric ORDER BY b) AS u, sum(n) OVER (PARTITION BY lvl, lang, source, metric) AS size FROM sketch),
quart AS (SELECT lvl, lang, source, metric, max(size) AS size, min(b) FILTER (u * 4 >= size) AS b1, min(b) FILTER (u * 4 >= size * 3) AS b3 FROM upto GROUP BY lvl, lang, source, metric),
edges AS (SELECT lvl, lang, source, metric, size, CASE WHEN b1 = 0 THEN 0.0::DOUBLE ELSE pow(1.02::DOUBLE, b1 - 1) END AS q1, CASE WHEN b3 = 0 THEN 0.0::DOUBLE ELSE pow(1.02::DOUBLE, b3 - 1) END AS q3 FROM quart),
picked AS (
  SELECT o.lang, o.source, o.metric, CASE WHEN o.size >= 100 THEN o.q1 WHEN l.size >= 100 THEN l.q1 ELSE a.q1 END AS q1, CASE WHEN o.size >= 100 THEN o.q3 WHEN l.size >= 100 THEN l.q3 ELSE a.q3 END AS q3
  FROM (SELECT * FROM edges WHERE lvl = 0) o JOIN (SELECT * FROM edges WHERE lvl = 1) l ON l.metric = o.metric AND l.lang IS NOT DISTINCT FROM o.lang JOIN (SELECT * FROM edges WHERE lvl = 2) a ON a.metric = o.metric),
fences AS (SELECT lang, source, metric, q1 - reach AS lo, q3 + reach AS hi FROM (SELECT *, greatest(6.0 * (q3 - q1), CASE metric WHEN 'symbol_ppm' THEN 50000.0 WHEN 'dup_line_ppm' THEN 400000.0 WHEN 'repeat_ppm' THEN 150000.0 ELSE 1500.0 END) AS reach FROM picked)),
bad AS (SELECT DISTINCT m.doc_id FROM metrics m JOIN fences f ON f.metric = m.metric AND f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source WHERE m.v > f.hi OR (m.metric = 'word_len' AND m.v < f.lo))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM rows_
"""

def op11_parity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, the near words of each, its form and its root."""
    return _spelling.spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


# fixed values: CRC-32 of the sixteen half bytes
_CRC = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11_SQL = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents),
each_ AS (SELECT doc_id, translate(raw, '{_UPPER}', '{_LOWER}') AS run, count(*) AS c FROM runs GROUP BY ALL),
hexed AS (SELECT run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM each_),
halves AS (SELECT run, c, list_transform(range(length(x)), lambda i: ('0x' || substr(x, (i + 1 + 1 - 2 * (i % 2))::INT, 1))::BIGINT) AS hs FROM hexed),
crcs AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, hs), lambda a, h: xor(a >> 4, ({_CRC})[(xor(a, h) & 15) + 1]::BIGINT)), 4294967295::BIGINT) AS h FROM halves),
odd AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM crcs),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM odd WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cuts AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
longer AS (SELECT DISTINCT c.word AS a, w.word AS b FROM cuts c JOIN words w ON c.k = w.word),
near AS (SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.k = b.k AND a.i = b.i AND a.word <> b.word UNION ALL SELECT a, b FROM longer UNION ALL SELECT b, a FROM longer),
best AS (SELECT a, count(*) AS n_near, max(w.n) AS top, arg_min(b, (-w.n, b)) AS b FROM near JOIN words w ON w.word = b GROUP BY a),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(x.n_near, 0) AS n_near, CASE WHEN x.top >= 2 * w.n THEN x.b END AS form, CASE WHEN x.top >= 2 * w.n THEN x.top END AS form_n FROM words w LEFT JOIN best x ON x.a = w.word),
chain(word, spot, step) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON f.word = c.spot WHERE f.form IS NOT NULL),
ends_ AS (SELECT word, arg_max(spot, step) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends_ e USING (word)
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings around 16 centroids after three rounds."""
    return _centroids.centroid_clusters(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _round_sql(r: int) -> str:
    exact = "(s - ((s % n) + n) % n) // n"
    return f"""
near{r} AS MATERIALIZED (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.rid, k.c, list_sum(list_transform(list_zip(v.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM vec v, cent{r} k) GROUP BY rid),
sums{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.c, unnest(v.v) AS x, unnest(range(64)) AS i FROM near{r} a JOIN vec v USING (rid)) GROUP BY c, i),
cent{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.v, k.v) AS v FROM cent{r} k LEFT JOIN (SELECT c, list({exact} ORDER BY i) AS v FROM sums{r} GROUP BY c) m USING (c)),"""


OP12_SQL = f"""
WITH vec AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64),
cent0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1 AS c, v FROM vec QUALIFY c < 16),{"".join(_round_sql(r) for r in range(4))}
by_cluster AS (SELECT c, sum(d)::BIGINT AS s FROM near3 GROUP BY c)
SELECT v.vec_id, a.c::INT AS cluster, a.d AS distance, b.s AS cluster_inertia, (SELECT sum(d)::BIGINT FROM near3) AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM near3 a JOIN vec v USING (rid) JOIN by_cluster b USING (c) JOIN cent3 k USING (c)
"""


def op13_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components of those that differ in two bits at most."""
    return _pivots.simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {
    "op1_poisson_mix": op1_poisson_mix,
    "op2_piece_sampling": op2_piece_sampling,
    "op3_trie_join": op3_trie_join,
    "op4_passage_dedup": op4_passage_dedup,
    "op5_block_naming": op5_block_naming,
    "op6_token_store": op6_token_store,
    "op7_byte_language": op7_byte_language,
    "op8_toxicity": op8_toxicity,
    "op9_page_text": op9_page_text,
    "op10_adaptive_rules": op10_adaptive_rules,
    "op11_parity_bands": op11_parity_bands,
    "op12_centroids": op12_centroids,
    "op13_pivot_simhash": op13_pivot_simhash,
}
ORACLE_SQL = {"op1_poisson_mix": OP1_SQL, "op3_trie_join": OP3_SQL, "op5_block_naming": OP5_SQL, "op10_adaptive_rules": OP10_SQL, "op11_parity_bands": OP11_SQL, "op12_centroids": OP12_SQL}
