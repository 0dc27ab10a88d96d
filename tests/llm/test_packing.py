import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from breezeframe.llm import packing

ODD = ["", "  ", "a b　c", "é x", "don't we'll 's 'sfoo", "<|endoftext|> hi", "İstanbul ΣΑΣ ß ﬁ", "日本語 テスト123", "a\x1cb \x85 c", "emoji \U0001f600", "́abc", "naïve café Zürich 12345 a1b2", " lead  trail\t\n", None]


@pytest.fixture(scope="module")
def parts():
    return packing.PartTable(packing.tokenizer_path())


def ids_of(parts, text):
    return parts.tok.encode(text, add_special_tokens=False).ids


def encoded(parts, texts):
    ids, n = parts.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


@given(st.integers(1, 50_000))
def test_binary_lengths(n):
    out = packing.binary_lengths(n)
    assert sum(out) == n and all(x & (x - 1) == 0 and x <= 4096 for x in out) and out == sorted(out, reverse=True)
    assert len(out) <= n // 4096 + 12
    assert packing.cut_documents(np.zeros(n - 1, np.uint32), np.array([n - 1]), 4096)[2].tolist() == out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_ids_are_the_tokenizers(parts, texts):
    assert encoded(parts, texts) == [ids_of(parts, t) for t in texts]


def test_table_starts_anew(parts, monkeypatch):
    monkeypatch.setattr(packing, "TABLE_BYTES", 2000)
    for k in range(30):
        text = " ".join(f"word{k}x{i}" for i in range(15))
        assert encoded(parts, [text, text[:20]]) == [ids_of(parts, text), ids_of(parts, text[:20])]
    assert parts.held < 20_000


def test_slices_cover_rows_once():
    texts = pa.array(["a" * n for n in (0, 5, 50, 3, 3, 0, 9)])
    assert list(packing.slices(texts, 10)) == [(0, 2), (2, 3), (3, 6), (6, 7)] and list(packing.slices(texts[:0], 10)) == []


def test_every_token_in_one_piece(spark, documents, parts):
    rows = [(i, t) for i, t in enumerate([*ODD, "many words here " * 3000])] + [(None, "no id"), (3, "again"), (3, "again")]
    out = packing.pack(documents(rows)).collect()
    assert len({r["sequence_id"] for r in out}) == len(out) and all(r["offset"] == 0 for r in out)
    for i, t in rows[: len(ODD) + 1]:
        if i == 3:
            continue
        ids = np.array([*ids_of(parts, t or ""), packing.END_ID], "<u4")
        mine = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        at = 0
        for r in mine:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["bucket"] == r["length"].bit_length() - 1
            at += r["length"]
        assert at == len(ids)
    assert sum(r["doc_id"] is None for r in out) == len(packing.binary_lengths(len(ids_of(parts, "no id")) + 1))
    assert packing.pack(documents([])).count() == 0


def test_clashing_columns(spark, documents):
    docs = documents([(1, "a b c")]).selectExpr("doc_id", "text", "'x' AS start", "'y' AS piece", "'z' AS sequence_id", "1.5 AS bucket")
    assert packing.pack(docs).drop("sequence_id").collect() == packing.pack(documents([(1, "a b c")])).drop("sequence_id").collect()


def test_query(spark, parts):
    data = "/root/testdata/sf0.001"
    out = packing.op7_packing(spark, data).toPandas()
    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas().sample(40, random_state=1)
    for i, t in zip(docs["doc_id"], docs["text"]):
        ids = np.array([*ids_of(parts, t or ""), packing.END_ID], "<u4")
        mine = out[out["doc_id"] == i].sort_values("start")
        assert mine["length"].sum() == len(ids) and (mine["doc_tokens"] == len(ids)).all()
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(mine["start"], mine["length"], mine["ids_crc32"]))
