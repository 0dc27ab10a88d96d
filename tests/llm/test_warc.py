import glob
import gzip
import hashlib
import json
import os

import duckdb
import pytest

from breezeframe.llm import warc

PAGES = "page_id long, url string, html string, html_digest string"
LONG = "<p>" + "same text " * 30 + "</p>"
ROWS = [
    (5, "http://b.example.org/x", LONG),
    (3, "http://a.example.org/y", LONG),
    (3, "http://a.example.org/y", LONG),
    (9, "http://a.example.org/y?q=é\r\nX: y", LONG),
    (None, "http://a.example.org/z", LONG),
    (4, None, LONG + "!"),
    (None, "http://c/", "other " * 40),
    (None, None, "other " * 40),
    (1, "not a url", "short"),
    (2, "not a url", "short"),
    (6, "http://u:p@h.example:80/", None),
    (7, "http://h.example/", ""),
    (8, "http://h.example/long", "<b>é</b>\n\0" * 300_000),
]


def pages(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(parts)


def files(folder):
    return {os.path.relpath(f, folder): open(f, "rb").read() for f in sorted(glob.glob(f"{folder}/**/*", recursive=True)) if os.path.isfile(f) and not f.endswith(".crc")}


def test_round_trip(spark, tmp_path):
    """Payloads, kinds and references of odd rows, one by one."""
    warc.write_pages(pages(spark, ROWS), f"file://{tmp_path}/w")
    got = warc.read_pages(spark, f"file://{tmp_path}/w").collect()
    assert len(got) == len(ROWS)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r["page_id"]), r["payload_digest"], r["payload_bytes"]) for r in got) == sorted((str(i), digest(t), len((t or "").encode())) for i, _, t in ROWS)
    for r in got:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        if r["payload"] is not None:
            assert digest(bytes(r["payload"]).decode()) == r["payload_digest"]
    of = lambda t: sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got if r["payload_digest"] == digest(t))
    assert of(LONG) == [("3", "response", None), ("3", "revisit", 3), ("5", "revisit", 3), ("9", "revisit", 3), ("None", "revisit", 3)]
    assert of("short") == [("1", "response", None), ("2", "response", None)]
    assert of(None) == [("6", "response", None), ("7", "response", None)]
    assert of("other " * 40) == [("None", "response", None), ("None", "revisit", None)]
    assert len({r["record_id"] for r in got}) == len(got)


def test_same_rows_same_bytes(spark, tmp_path, monkeypatch):
    """However the rows are dealt, the archive's files are equal; writing a set again changes nothing."""
    monkeypatch.setattr(warc, "RANGE_BYTES", 20_000)
    rows = [(i, f"http://h{i % 7}.example.org/{i % 50}", f"page {i % 90} " * 40) for i in range(400)]
    for name, parts in (("a", 1), ("b", 5), ("b", 2)):
        warc.write_pages(pages(spark, rows, parts), f"file://{tmp_path}/{name}", roll_bytes=3000)
    assert files(f"{tmp_path}/a") == files(f"{tmp_path}/b")
    assert not glob.glob(f"{tmp_path}/*/_temporary*")
    assert warc.read_pages(spark, f"file://{tmp_path}/b", payload="false").count() == 400


def test_files_roll_in_order(spark, tmp_path, monkeypatch):
    """Standard gzip reads every file; sizes keep to the limit; keys rise within and across files; the manifest tells the truth."""
    monkeypatch.setattr(warc, "RANGE_BYTES", 20_000)
    rows = [(i, f"http://h{i % 7}.example.org/{i:04d}", f"page {i} " * 40) for i in range(400)]
    warc.write_pages(pages(spark, rows), f"file://{tmp_path}/w", roll_bytes=3000)
    (manifest,) = glob.glob(f"{tmp_path}/w/set-*.json")
    listed = json.load(open(manifest))["files"]
    assert len(listed) > 20 and sum(x["records"] for x in listed) == 400
    uris = []
    for x in listed:
        raw = open(f"{manifest.removesuffix('.json')}/{x['name']}", "rb").read()
        assert len(raw) == x["bytes"] <= 3000 and hashlib.sha256(raw).hexdigest() == x["sha256"]
        text = gzip.decompress(raw).decode()
        assert text.startswith("WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        uris += [line.split(": ")[1] for line in text.split("\r\n") if line.startswith("WARC-Target-URI")]
    assert uris == sorted(uris) and len({x["name"].split("-")[1] for x in listed}) > 3


def test_damage_is_told(spark, tmp_path):
    warc.write_pages(pages(spark, ROWS[:4]), f"file://{tmp_path}/w")
    reader = warc.WarcReader(f"file://{tmp_path}/w", True)
    (part,) = reader.partitions()
    path = f"{tmp_path}/w/{part.path}"
    raw = open(path, "rb").read()
    open(path, "wb").write(raw[:-9])
    with pytest.raises(OSError, match="ends at byte"):
        list(reader.read(part))
    members = [m for _, m in warc.WarcReader.members(reader, warc._File(part.path, len(raw)))] if open(path, "wb").write(raw) else []
    changed = members[1].replace(b"same text", b"some text", 1)
    with pytest.raises(ValueError, match="digest"):
        reader.row(changed)


def test_append_and_overwrite(spark, tmp_path):
    uri = f"file://{tmp_path}/w"
    warc.write_pages(pages(spark, ROWS[:2]), uri)
    warc.write_pages(pages(spark, ROWS[2:5]), uri)
    assert warc.read_pages(spark, uri).count() == 5
    warc.write_pages(pages(spark, ROWS[8:9]), uri, mode="overwrite")
    assert [r["page_id"] for r in warc.read_pages(spark, uri).collect()] == [1] and len(glob.glob(f"{tmp_path}/w/*")) == 2


def test_abort_leaves_nothing(spark, tmp_path):
    writer = warc.WarcWriter(f"file://{tmp_path}/w", 1000, warc.DATE, False)
    message = writer.write(iter([]))
    writer.abort([message, None])
    assert not glob.glob(f"{tmp_path}/w/*")


def test_empty(spark, tmp_path):
    warc.write_pages(pages(spark, []), f"file://{tmp_path}/w")
    assert warc.read_pages(spark, f"file://{tmp_path}/w").count() == 0


def test_hot_url_is_cut(spark, monkeypatch):
    """A URL of a third of all rows spans several ranges."""
    monkeypatch.setattr(warc, "RANGE_BYTES", 2_000)
    rows = [(i, "http://hot/" if i % 3 == 0 else f"http://h{i}/", f"{i} " * 20) for i in range(900)]
    df = pages(spark, rows)
    parts = warc.records_of(df, warc.heads_of(df)).where("url = 'http://hot/'").groupBy("part").count().collect()
    assert len(parts) > 5


def test_query_agrees_with_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    want = con.sql(warc.OP11_SQL)
    got = warc.op11_warc(spark, data).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
