import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts, seen = docs.columns, [docs.count()], [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        counts.append(docs.count())
        seen.append(docs)
        if name != "packing":
            assert docs.columns == columns
    quality, lines, near = (counts[k] for k in (1, 2, 3))
    assert quality < counts[0] and lines == quality and near <= lines
    # Copies lose their lines first, so here the near-duplicate stage is also given the documents as they are.
    assert corpus_pipeline.near_duplicate_stage(spark, seen[0], DATA).count() < counts[0]
    texts = seen[3].where("trim(text) <> ''").select("text")
    assert texts.count() == texts.distinct().count()
    length = lambda d: d.selectExpr("sum(length(text))").first()[0]
    assert length(seen[2]) < length(seen[1])
    assert counts[5] > 0 and seen[5].where("length > 4096").count() == 0


def test_quality_stage_keeps_good_documents(spark):
    """Held-out labels at a size that has some hundred of them: documents labelled as bad go, the others stay."""
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, data).select("doc_id").collect()}
    held = labels.join(docs, "doc_id", "left_semi").where("quality IS NOT NULL AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0").collect()
    assert sum((r["doc_id"] in kept) == (r["quality"] == 1) for r in held) >= 0.95 * len(held)
    assert all(r["doc_id"] in kept for r in held if r["quality"] == 1)


ODD = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "the river of stone and water " * 20, "en", "a", 1), (2, "the river of stone and water " * 20, "en", "a", 1), (None, "a\n\nb " * 3, None, "b", 2), (3, "word " * 60_000, "fr", None, 3)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_take_odd_rows(spark, name, stage):
    """Nulls everywhere, empty and very long texts, repeated rows, clashing names, and no rows at all."""
    extra = ["_src", "_key", "d", "t", "row", "name", "root", "tie", "size", "target", "score", "removed"]
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'own {n}' AS `{n}`" for n in extra])
    out = stage(spark, docs, DATA)
    rows = out.collect()
    assert out.columns == docs.columns and all(r[n] == f"own {n}" for r in rows for n in extra)
    assert {(r["doc_id"], r["lang"], r["source"], r["n_chars"]) for r in rows} <= {(r[0], *r[2:]) for r in ODD}
    assert stage(spark, docs.limit(0), DATA).count() == 0
    if name == "near duplicates":
        assert sorted(r["n_chars"] or 0 for r in rows) == [0, 0, 1, 2, 3]
    if name == "line dedup":
        assert len(rows) == len(ODD)


def test_packing_takes_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.packing_stage(spark, docs, DATA).groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"] for r in out} == {None, 1, 2, 3} and corpus_pipeline.packing_stage(spark, docs.limit(0), DATA).count() == 0
