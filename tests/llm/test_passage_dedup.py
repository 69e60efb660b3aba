import random

from quillmill.llm import passage_dedup as P

from .helpers import DOCS, docs, stored


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_planted_passages_are_found_and_clean_ones_stay(spark, tmp_path):
    rng = random.Random(3)
    passage = prose(rng, 60)
    near = passage.split()
    near[2] = "changed"
    rows = [(i, prose(rng, 150), "en", "a") for i in range(12)]
    rows += [(20 + i, prose(rng, 40 + i) + " " + (passage if i % 2 else " ".join(near)) + " " + prose(rng, 50), "en", "a") for i in range(6)]
    rows += [(40, rows[0][1], "en", "a")]
    df = stored(spark, tmp_path, docs(spark, rows))
    got = {r.doc_id: r for r in P.per_document(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].n_repeated == 0 for i in range(1, 12))
    assert all(got[20 + i].repeated_words >= 20 for i in range(6))
    assert got[20].removed_words == 0 and all(got[21 + i].keep_ids == [20] for i in range(5))
    assert got[0].removed_words == 0 and got[40].keep_ids == [0] and got[40].removed_words > 140
    left = {r.doc_id: r.text for r in P.remove_repeats(df).collect()}
    assert left[3] == rows[3][1] and left[20] == rows[12][1] and len(left[21]) < len(rows[13][1])
    # small blocks give the same
    assert {r.doc_id: r for r in P.per_document(df, block=2).collect()} == got


def test_short_passages_with_an_edit_are_found_whole(spark, tmp_path):
    rng = random.Random(11)
    rows, planted = [], {}
    for i in range(120):
        n = rng.randint(51, 60)
        first = prose(rng, n).split()
        again = list(first)
        if i % 3 == 1:
            again[n // 2] = "changed"
        elif i % 3 == 2:
            again[n // 2 : n // 2 + 1] = ["put", "between"]
        for k, words in enumerate((first, again)):
            rows.append((2 * i + k, f"{prose(rng, rng.randint(5, 80))} {' '.join(words)} {prose(rng, rng.randint(5, 80))}", "en", "a"))
        planted[2 * i + 1] = len(again)
    df = stored(spark, tmp_path, docs(spark, rows))
    got = {r.doc_id: r for r in P.per_document(df).collect()}
    for i, n in planted.items():
        assert got[i].removed_words == n and got[i].keep_ids == [i - 1] and got[i].n_removed == 1
        assert got[i - 1].removed_words == 0 and n - 1 <= got[i - 1].repeated_words <= n
    assert all("changed" not in (r.text or "") and "between" not in (r.text or "") for r in P.remove_repeats(df).collect())


def test_verified_links_are_exact():
    rng = random.Random(5)
    cutter = P.Cutter()
    text = prose(rng, 300) + "\n" + prose(rng, 30)
    starts, size, sets, owner = cutter.cut(text)
    words = text.split()
    assert size.sum() == len(words) and len(starts) == len(size)
    at = 0
    for i, n in enumerate(size.tolist()):
        own = words[at : at + n]
        assert len({tuple(own[j : j + 5]) for j in range(n - 4)}) == (owner == i).sum()
        at += n


def test_awkward_rows(spark, tmp_path):
    df = stored(spark, tmp_path, docs(spark))
    got = P.per_document(df).collect()
    assert len(got) == df.count()
    assert [r.n_removed for r in got if r.doc_id == 6] == [0]
    assert [r.keep_ids for r in got if r.doc_id == 7] == [[6]]
    assert all(r.n_repeated == 0 for r in got if r.doc_id in (3, 4, 5, 8, 9, 10))
    extra = df.withColumn("rid", df["doc_id"]).withColumn("idx", df["doc_id"])
    assert P.remove_repeats(extra).columns == extra.columns
    empty = stored(spark, tmp_path, spark.createDataFrame([], DOCS), "empty")
    assert P.per_document(empty).count() == 0
