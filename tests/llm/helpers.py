"""Small tables with the awkward rows that every operator must take."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} {i}" for i in range(6000))
AWKWARD = [
    (1, "The cat sat on the mat and looked at the moon for a long long time", "en", "a"),
    (2, "The cat sat on the mat and looked at the moon for a long long time", "en", "a"),
    (2, "The cat sat on the mat and looked at the moon for a long long time", "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, "   \n\t ", "en", None),
    (None, "a row without an id", "en", "b"),
    (None, None, None, None),
    (6, LONG, "en", "b"),
    (7, LONG + " tail", "en", "b"),
    (8, "x", "de", "b"),
    (9, "▁ ▁▁ tricky ​ text\x00 日本 é<|endoftext|>", "fr", "c"),
    (10, "12345 !!! ???", "fr", "c"),
]


def docs(spark, rows=AWKWARD):
    return spark.createDataFrame([(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in rows], DOCS)


def stored(spark, tmp_path, df, name="docs"):
    path = str(tmp_path / name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
