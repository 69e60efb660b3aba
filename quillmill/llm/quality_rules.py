"""Quality rules with adaptive thresholds, in built-in functions only.

Per document four counts are taken from the whole text (see `features`). Documents that fail the base
rule go. For the others, three ratios in parts per million and the mean word length are summarised by mergeable quantile sketches, one per
language and source: a sketch is a histogram over buckets that grow by the factor GAMMA, so that any
quantile is known to a relative error of (GAMMA - 1) / 2, sketches of parts add up to the sketch of the
whole, and the sums don't depend on partitioning. From each sketch comes a fence, the third quartile
plus FENCE times the distance between the quartiles and at least a floor of its own, and for the word
length a lower fence too. The sketches of a language and of the whole table stand in for groups of fewer than MIN_GROUP
documents. The fences are joined back and filter the documents.

Defined results: null and empty texts have no words and fail the base rule; null lang or source is a
group of its own; repeated rows count each; an empty table gives an empty result; other columns are carried
along by `quality_filter` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, saved

WINDOW = 5
GAMMA = 1.02
MIN_GROUP = 100
FENCE = 6.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Least distance of a fence from its quartile, by metric (parts per million; for word_len, thousandths of a character).
FLOORS = {"symbol_ppm": 50_000, "dup_line_ppm": 400_000, "repeat_ppm": 150_000, "word_len": 1_500}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words that stand in a window of WINDOW words found twice or more, from the windows' hashes in order."""

    def covered(sorted_: Column) -> Column:
        n = F.size(sorted_)
        # windows equal to a neighbour in the sorted order, as positions
        found = F.array_sort(
            F.filter(
                F.transform(
                    sorted_,
                    lambda x, i: F.when(
                        ((i > 0) & (F.get(sorted_, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(sorted_, i + 1)["h"] == x["h"])), x["p"]
                    ),
                ),
                lambda p: p.isNotNull(),
            )
        )
        return _let(
            found,
            lambda ps: F.aggregate(
                F.transform(ps, lambda p, i: F.coalesce(F.least(F.lit(WINDOW), F.get(ps, i + 1) - p), F.lit(WINDOW))), F.lit(0).cast("long"), lambda acc, x: acc + x
            ),
        )

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    # only texts in which some window comes back pay for the sort
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(F.sort_array(pairs), covered))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, without columns of these names, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, all but the last long.

    Words are runs of characters other than ASCII white space.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # one kind of ASCII white space, so that a plain split finds the words
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    words = F.filter(F.split(flat, " "), lambda w: w != "")
    # lines with a word; a repeated one is equal to an earlier one
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0)

    def counts(w: Column) -> Column:
        n = F.size(w)
        hashes = _let(
            F.transform(w, lambda x: F.xxhash64(x)),
            lambda h: F.when(
                n >= WINDOW,
                F.transform(F.slice(h, 1, F.greatest(n - WINDOW + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])),
            ).otherwise(F.array().cast("array<bigint>")),
        )
        return F.struct(n.cast("long").alias("n_words"), _let(hashes, _repeat_words).alias("n_repeat_words"))

    spaces = F.length(F.translate(flat, " ", ""))
    own = {x.lower() for x in (*COUNTS, "n_lines", "base_failed")}
    docs = docs.select(*[F.col(f"`{x}`") for x in docs.columns if x.lower() not in own])
    c, ls = free(docs, "__c"), free(docs, "__l")
    out = docs.withColumn(c, _let(words, counts)).withColumn(ls, lines)
    out = out.select(
        *[F.col(f"`{x}`") for x in docs.columns],
        F.col(f"{c}.n_words").alias("n_words"),
        spaces.cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        F.col(f"{c}.n_repeat_words").alias("n_repeat_words"),
        F.size(ls).cast("long").alias("n_lines"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _metrics() -> dict[str, Column]:
    ppm = lambda a, b: F.expr(f"CAST(({a} * 1000000L) DIV greatest({b}, 1L) AS BIGINT)")
    return {
        "symbol_ppm": ppm("n_symbols", "word_chars"),
        "dup_line_ppm": ppm("n_dup_lines", "n_lines"),
        "repeat_ppm": ppm("n_repeat_words", "n_words"),
        "word_len": F.expr("CAST((word_chars * 1000L) DIV greatest(n_words, 1L) AS BIGINT)"),
    }


def bucket(value: Column) -> Column:
    """Bucket of a value of 0 or more: 0 for 0, else 1 + the power of GAMMA below it, rounded to be alike on any machine."""
    return F.when(value <= 0, F.lit(0)).otherwise(1 + F.floor(F.round(F.ln(value.cast("double")) / F.lit(_LN), 9)).cast("int"))


_LN = 0.019802627296179712  # ln(GAMMA)


def sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mergeable sketches: (group columns, metric, bucket, n). The union of two, summed over n, is the sketch of both."""
    kinds = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in _metrics().items()])
    return rows.select(*by, F.explode(kinds).alias("k")).select(*by, "k.metric", "k.bucket").groupBy(*by, "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(group columns, metric, size, q1, q3) of sketches; a quartile is the lower edge of the bucket it falls in."""
    w = Window.partitionBy(*by, "metric").orderBy("bucket")
    whole = Window.partitionBy(*by, "metric")
    seen = sketch.withColumn("upto", F.sum("n").over(w)).withColumn("size", F.sum("n").over(whole))
    edge = lambda b: F.when(b == 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), (b - 1).cast("double")))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("size") * q, F.col("bucket")))
    return seen.groupBy(*by, "metric").agg(F.max("size").alias("size"), edge(at(1)).alias("q1"), edge(at(3)).alias("q3"))


def thresholds(rows: DataFrame) -> DataFrame:
    """One row per lang and source of rows: lang, source, and lo_ and hi_ of each metric."""
    by_source = saved(sketches(rows.where("NOT base_failed"), ["lang", "source"]), "sketches")
    merged = lambda by: by_source.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    own = quartiles(by_source, ["lang", "source"])
    wide = own
    for by, tag in ((["lang"], "l"), ([], "a")):
        up = quartiles(merged(by), by).select(*[F.col(c).alias(f"{tag}_{c}") for c in by], F.col("metric").alias(f"{tag}_metric"), *[F.col(c).alias(f"{tag}_{c}") for c in ("size", "q1", "q3")])
        on = wide["metric"] == up[f"{tag}_metric"]
        for c in by:
            on = on & wide[c].eqNullSafe(up[f"{tag}_{c}"])
        wide = wide.join(up, on, "left")
    pick = lambda q: F.when(F.col("size") >= MIN_GROUP, F.col(q)).when(F.col("l_size") >= MIN_GROUP, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))
    floor = F.create_map(*[F.lit(x) for k, v in FLOORS.items() for x in (k, float(v))])[F.col("metric")]
    reach = F.greatest(F.lit(FENCE) * (pick("q3") - pick("q1")), floor)
    fences = wide.select("lang", "source", "metric", (pick("q1") - reach).alias("lo"), (pick("q3") + reach).alias("hi"))
    return fences.groupBy("lang", "source").pivot("metric", list(FLOORS)).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))


def judge(rows: DataFrame) -> DataFrame:
    """rows (of `features`, with lang and source) with kept: false if base_failed, else whether all metrics lie within their group's fences."""
    limits = thresholds(rows)
    limits = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[c for c in limits.columns if c not in ("lang", "source")])
    joined = rows.join(limits, rows["lang"].eqNullSafe(limits["__lang"]) & rows["source"].eqNullSafe(limits["__source"]), "left")
    fine = F.lit(True)
    for k, v in _metrics().items():
        fine = fine & F.coalesce(v <= F.col(f"{k}_hi"), F.lit(True))
    fine = fine & F.coalesce(_metrics()["word_len"] >= F.col("word_len_lo"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & fine).select(*rows.columns, "kept")


def quality_rules(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: its id, lang, source, counts, base_failed and kept."""
    counted = features(docs.select(F.col(f"`{id_col}`").alias("doc_id"), "lang", "source", "text")).drop("text")
    return judge(saved(counted, "counts"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, all their columns untouched. docs must be a table or a written intermediate: its rows are numbered by position twice."""
    tag = free(docs, "__quillmill_rid")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "lang", "source", "text")
    good = judge(saved(features(rows).drop("text"), "counts")).where("kept").select(F.col("rid").alias(tag))
    return docs.withColumn(tag, F.monotonically_increasing_id()).join(good, tag, "left_semi").drop(tag)
