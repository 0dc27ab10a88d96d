import glob
import hashlib
import json
import zlib

import pytest

from breezeframe.llm import media


@pytest.mark.parametrize("raw", [b"", b"a", b"x" * 64, b"y" * 65, bytes(range(256)) * 40])
def test_picture_round_trip(raw):
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and payload[: len(raw)] == raw and (not raw or len(payload) - len(raw) < 64)
    assert media.from_png(media.to_png(payload)).tobytes() == payload


def test_archive_round_trip(spark, documents, tmp_path):
    rows = [(i, f"text {i} é " * (i % 50)) for i in range(300)] + [(None, "no id"), (7, None), (8, ""), (9, "long " * 100_000), (9, "long " * 100_000)]
    uri = f"file://{tmp_path}/archive"
    media.write_documents(documents(rows).repartition(3), uri)
    back = media.read_media(spark, uri, range_bytes=4000)
    assert back.rdd.getNumPartitions() > 5
    got = sorted(((r["key"], r["n_bytes"], media.from_png(bytes(r["media"])).tobytes()) for r in back.collect()), key=str)
    want = sorted(((i, len((t or "").encode()), media.padded((t or "").encode())) for i, t in rows), key=str)
    assert got == want


def test_damaged_member_is_told(spark, documents, tmp_path):
    uri = f"file://{tmp_path}/archive"
    media.write_documents(documents([(1, "abc"), (2, "def")]).coalesce(1), uri)
    reader = media.MediaReader(uri, 1 << 20, 2)
    part = reader.partitions()[0]
    path = f"{tmp_path}/archive/{part.name}"
    data = bytearray(open(path, "rb").read())
    data[-5] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(OSError, match="the member at byte"):
        list(reader.read(part))


def test_retries_read_a_member_alone(spark, documents, tmp_path):
    uri = f"file://{tmp_path}/archive"
    media.write_documents(documents([(1, "abc"), (2, "def")]).coalesce(1), uri)

    class Flaky:
        def __init__(self, path):
            self.f, self.fails = open(path, "rb"), 2

        def read_at(self, n, at):
            self.f.seek(at)
            if self.fails:
                self.fails -= 1
                raise OSError("gone for a moment")
            return self.f.read(n)

    reader = media.MediaReader(uri, 1 << 20, 4)
    key, n, _ = reader.member(Flaky(f"{tmp_path}/archive/{reader.partitions()[0].name}"), 0, "x")
    assert (key, n) == (1, 3)


def test_digests(spark, documents, tmp_path):
    uri = f"file://{tmp_path}/archive"
    media.write_documents(documents([(1, "same"), (2, "same"), (3, None)]), uri)
    out = {r["doc_id"]: r for r in media.read_media(spark, uri).mapInArrow(media._digest, media.DIGESTS).collect()}
    p = media.padded(b"same")
    assert out[1]["payload_sha256"] == hashlib.sha256(p).hexdigest() and out[1]["tail_crc32"] == zlib.crc32(p[-64:]) and out[1][2:] == out[2][2:]
    assert out[3]["n_bytes"] == 0 and out[3]["payload_bytes"] == 64
    assert json.load(open(glob.glob(f"{tmp_path}/archive/_archives-*.json")[0]))


def test_empty(spark, documents, tmp_path):
    uri = f"file://{tmp_path}/archive"
    media.write_documents(documents([]), uri)
    assert media.read_media(spark, uri).count() == 0


def test_append_and_overwrite(spark, documents, tmp_path):
    """A second write stands beside the first; an overwriting one takes the place of both, files too."""
    uri = f"file://{tmp_path}/archive"
    keys = lambda: sorted(r["key"] for r in media.read_media(spark, uri).collect())
    media.write_documents(documents([(1, "a")]), uri)
    media.write_documents(documents([(2, "b"), (3, "c")]), uri)
    assert keys() == [1, 2, 3]
    spark.createDataFrame([(4, 1, bytearray(b"x"))], media.SCHEMA).write.format("media_archive").mode("overwrite").save(uri)
    assert keys() == [4] and len(glob.glob(f"{tmp_path}/archive/*.media")) == 1


def test_clashing_columns(spark, documents, tmp_path):
    uri = f"file://{tmp_path}/archive"
    media.write_documents(documents([(1, "a")]).withColumnsRenamed({"lang": "key", "source": "media", "n_chars": "n_bytes"}), uri)
    assert [r["key"] for r in media.read_media(spark, uri).collect()] == [1]


def test_query(spark):
    """Every column against plain loops; pixels are decoded by the test's own reader."""
    data = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = media.op10_media(spark, data).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        raw = docs[r["doc_id"]]
        p = raw + b"\0" * ((-len(raw)) % 64 or (64 if not raw else 0))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        stored = media.to_png(p)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        mean = 1000 * sum(p) // len(p)
        spread = 1000 * (len(p) * sum(x * x for x in p) - sum(p) ** 2) // len(p) ** 2
        rows = [p[k : k + 64] for k in range(0, len(p), 64)]
        cuts = [len(rows) * k // 8 for k in range(9)]
        bits = 0
        for a, b in zip(cuts, cuts[1:]):
            for c in range(8):
                cell = sum(sum(x[8 * c : 8 * c + 8]) for x in rows[a:b]) * 1000 // (max(b - a, 1) * 8)
                bits = bits << 1 | (cell > mean)
        assert r["feature"] == f"{mean}:{spread}:{bits:016x}"
