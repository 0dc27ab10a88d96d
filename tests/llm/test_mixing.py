import duckdb
import pytest

from breezeframe.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, size string"


def brute_targets(sizes: dict, weights=(5, 2, 1), most=3):
    """Share, cut at the cap, reshare the excess by weight until none is above."""
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [k for k in names if k not in capped]
        left = total - sum(most * sizes[k] for k in capped)
        target = {k: most * sizes[k] if k in capped else left * w[k] / sum(w[x] for x in free) for k in names}
        over = {k for k in free if target[k] > most * sizes[k]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500}, {"a": 100, "b": 100, "c": 100, None: 7}, {"a": 1, "b": 2, "c": 3, "d": 10_000}, {"a": 0, "b": 5}, {"a": 9}])
def test_targets(spark, sizes):
    rows = [("1" if k is None else f"0{k}", v) for k, v in sizes.items()]
    got = {r["_src"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "_src string, source_size long")).collect()}
    want = {"1" if k is None else f"0{k}": v for k, v in brute_targets(sizes).items()}
    assert got == pytest.approx(want)


def test_taken_fills_targets(spark):
    rows = [(i, "w " * (i % 17), "en", f"s{i % 4}" if i % 9 else None, "clash") for i in range(400)] + [(None, None, None, None, None), (5, "same text", "en", "s1", ""), (5, "same text", "en", "s1", "")]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        t, target = by.setdefault(r["source"], [0, r["target"]])
        by[r["source"]][0] = t + r["taken"]
    for taken, target in by.values():
        assert abs(taken - target) <= 1
    assert sum(t for t, _ in by.values()) == pytest.approx(sum(r["size"] for r in out), abs=len(by))


def test_same_again_and_rows_repeat(spark):
    rows = [(i, "word " * (1 + i % 5), "en", "abc"[i % 3], "x") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    a = sorted(map(tuple, mixing.mixed_documents(docs).collect()))
    b = sorted(map(tuple, mixing.mixed_documents(docs.repartition(7)).collect()))
    assert a == b and set(a) <= set(rows) and mixing.mixed_documents(docs).columns == docs.columns
    times = [a.count(r) for r in set(a)]
    assert max(times) >= 2


def test_unlike_texts_of_one_id_draw_their_own_keys(spark):
    """Texts without an id, all of one size, spread over keys; the same text under the same id draws the same key."""
    rows = [(None, f"word{i} " * 5) for i in range(500)] + [(7, "one text"), (7, "one text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = docs.select(mixing.exponential_key(docs["doc_id"], docs["text"], mixing.F.lit(1.0)).alias("k"))
    assert keys.distinct().count() == 501


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quality_draws_first(spark):
    """Within a source that is not wholly taken, clean texts are taken more often than littered ones."""
    rows = [(i, ("clean " * 20) if i % 2 else ("a## b$$ " * 10), "en", "c" if i < 1000 else "a", "") for i in range(1400)]
    out = [r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect() if r["source"] == "c"]
    rate = lambda odd: sum(r["taken"] for r in out if r["doc_id"] % 2 == odd) / sum(r["size"] for r in out if r["doc_id"] % 2 == odd)
    assert out[0]["target"] < out[0]["source_size"] and rate(1) > 1.3 * rate(0)


def test_clashing_columns(spark):
    """Columns of the caller come back as they were, whatever their names."""
    names = ["_src", "_key", "_tie", "_fine", "_coarse", "_before", "_epochs", "row", "target", "taken"]
    docs = spark.createDataFrame([(i, "word " * 5, "abc"[i % 3]) for i in range(60)], "doc_id long, text string, source string").selectExpr("*", *[f"'own {n}' AS `{n}`" for n in names])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert all(r[n] == f"own {n}" for r in out.collect() for n in names)
    assert all(r[n] == f"own {n}" for r in mixing.mix(docs).collect() for n in names[:8])


def test_agrees_with_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got, want = mixing.op3_mixing(spark, data), con.sql(mixing.OP3_SQL)
    assert got.columns == want.columns
    for a, b in zip(sorted(map(tuple, got.collect())), sorted(want.fetchall()), strict=True):
        assert a == pytest.approx(b)
