import random

import pytest

from breezeframe.llm import minhash

WORDS = [f"w{i}" for i in range(400)]


def brute(rows, size):
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return {rows[i][0]: (len(sets[i]), min(groups[find(i)])) for i in range(len(rows))}


def corpus(seed):
    r = random.Random(seed)
    base = [r.choices(WORDS, k=r.randint(20, 120)) for _ in range(25)]
    rows = []
    for k, b in enumerate(base):
        rows.append((len(rows), " ".join(b)))
        for _ in range(r.choice((0, 0, 1, 2, 60 if k == 3 else 4))):
            c = list(b)
            for _ in range(r.randint(0, max(1, len(c) // 25))):
                c[r.randrange(len(c))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(c)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,short", [(4, 32), (5, 32), (5, 2)])
def test_same_as_brute_force(spark, documents, monkeypatch, size, short):
    """With short = 2 nearly all lists go through the blocks."""
    monkeypatch.setattr(minhash, "SHORT_LIST", short)
    rows = corpus(size)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(documents(rows), size).collect()}
    assert got == brute(rows, size)


def test_edge_cases(spark, documents):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One TWO"), (6, "one two three four five six"), (6, "one two three four five six"), (None, "one two three four five six"), (7, "x " * 30_000), (8, "x " * 29_000)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(documents(rows), 4).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 3, 6, True), (6, 3, 6, True), (None, 3, 6, False), (7, 1, 7, True), (8, 1, 7, False)], key=str)
    assert minhash.near_duplicates(documents([]), 4).count() == 0


def test_one_of_each_group_stays(spark, documents):
    rows = corpus(9)
    docs = documents(rows).withColumnRenamed("n_chars", "component_id")
    kept = {r["doc_id"] for r in minhash.without_near_duplicates(docs, 5).collect()}
    want = brute(rows, 5)
    assert kept == {c for _, c in want.values()} and minhash.without_near_duplicates(docs, 5).columns == docs.columns


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["id"]: r["root"] for r in minhash.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_classes_of_null_ids_only(spark, documents):
    """Near copies of a document under null ids are linked with it; rows of one id with other texts stay apart."""
    base = WORDS[:60]
    near = [" ".join([*base[:-1], w]) for w in ("x1", "x2")]
    rows = [(5, " ".join(base)), (None, near[0]), (None, near[1]), (None, near[1]), (None, " ".join(WORDS[100:140])), (7, " ".join(WORDS[200:240])), (7, near[0])]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(documents(rows), 5).collect()), key=str)
    assert got == sorted([(5, 5, True), *[(None, 5, False)] * 3, (None, None, True), (7, 7, True), (7, 5, False)], key=str)
    left = sorted(((r["doc_id"], r["text"]) for r in minhash.without_near_duplicates(documents(rows), 5).collect()), key=str)
    assert left == sorted([rows[0], rows[4], rows[5]], key=str)


def test_one_row_of_repeated_ones_stays(spark, documents):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (2, None), (None, "p q r s t"), (None, "p q r s t"), (3, "")]
    docs = documents(rows).withColumnsRenamed({"lang": "name", "source": "row", "n_chars": "root"})
    left = minhash.without_near_duplicates(docs, 5)
    assert left.columns == docs.columns and {r["row"] for r in left.collect()} == {"s"}
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([rows[0], (2, None), (2, None), rows[4], rows[6]], key=str)


def test_query(spark):
    data = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], (r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.op1_near_duplicates(spark, data).collect()}
    assert got == brute(rows, 4)
