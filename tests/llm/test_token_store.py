import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmill.llm import token_store as S

from .helpers import AWKWARD, DOCS, docs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 33), max_size=700), st.integers(-5, 1 << 40))
def test_elias_fano_round_trip(gaps, base):
    values = base + np.cumsum(np.array(gaps, np.int64)) if gaps else np.zeros(0, np.int64)
    if len(values) and int(values[-1] - values[0]) > 1 << 36:
        values = base + (values - base) // (1 << 10)
    code = S.EliasFano(S.EliasFano.encode(values))
    assert code.all().tolist() == values.tolist()
    assert [code.select(i) for i in range(0, len(values), 37)] == values[::37].tolist()
    with pytest.raises(IndexError):
        code.select(len(values))


def test_size_is_near_minimal():
    values = np.cumsum(np.random.default_rng(1).integers(0, 2000, 20_000))
    assert len(S.EliasFano.encode(values)) * 8 / 20_000 < 2 + 10 + 1.5


FRESH = Tokenizer.from_file(S.tokenizer_path())  # none of the encoder's settings


def plain(text):
    return [*FRESH.encode(text or "", add_special_tokens=False).ids, 0]


ODD = ["hello <|endoftext|> world", "x<|endoftext|>", "naïve Über... ſtop ɐpple ²½ it's 12abc","  two  spaces \n x", "a \n\n b", "tail ", "\n lead", " x", "a  b", "x\n ", "word\n\nnext  \n three", "\x1c \x1c", "a\t b\r\n c", "don't we'll", "a" * 5000]


def test_encoder_equals_the_library():
    e = S.Encoder(S.tokenizer_path())
    e.MAX_PIECES = 50  # the table is tidied often
    texts = [t or "" for _, t, *_ in AWKWARD] + ODD
    for _ in range(3):
        ids, n = e.encode(texts, 0)
        at = 0
        for t, m in zip(texts, n.tolist(), strict=True):
            assert ids[at : at + m].tolist() == plain(t)
            at += m


@pytest.mark.parametrize("block", [S.BLOCK_IDS, 50])
def test_store_round_trip(spark, tmp_path, block):
    rows = AWKWARD + [(100 + i, t, "en", "s") for i, t in enumerate(ODD)]
    S.write_store(docs(spark, rows), str(tmp_path / f"s{block}"), S.tokenizer_path(), block_ids=block)
    found = S.read_store(spark, str(tmp_path / f"s{block}")).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    want, at = [], 0
    for i, t, *_ in sorted(rows, key=key):
        ids = plain(t)
        want.append((i, at, len(ids), ids))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, list(r.value)) for r in found), key=lambda x: x[1]) == want


def test_fold_and_empty_table(spark, tmp_path):
    S.write_store(docs(spark), str(tmp_path / "f"), S.tokenizer_path())
    for r in S.read_store(spark, str(tmp_path / "f"), S.crc32, "bigint").where("doc_id = 1").collect():
        assert r.value == zlib.crc32(np.array(plain(AWKWARD[0][1]), "<u4").tobytes())
    S.write_store(spark.createDataFrame([], DOCS), str(tmp_path / "none"), S.tokenizer_path())
    assert S.read_store(spark, str(tmp_path / "none")).count() == 0
