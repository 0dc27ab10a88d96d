import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from breezeframe.llm import collocations as co


def brute(rows, longest=3, least=10, share=50):
    """(lang, phrase) -> (a, l, r, n, score) of all candidates that stay."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(words[k : k + n])) for k in range(len(words) - n + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in found.items():
        inside = lambda x: any(x[k : k + len(words)] == words for k in range(len(x) - len(words) + 1))
        if any(x[0] == lang and len(x[1]) > len(words) and 100 * f >= share * a and inside(x[1]) for x, f in found.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out[lang, " ".join(words)] = (a, l, r, totals[lang], score)
    return out


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "x", "rare", "é", "naïve", "İ", " ", "w'w", "long" * 30]
    return [(rng.choice(["en", "en", "en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"]) for _ in range(rng.randrange(60)))) for _ in range(n)]


ODD = [("en", None), ("en", ""), ("en", " . , \n"), (None, "same words here " * 40), ("fr", "a a a a a a a a a a a a a"), ("en", "only once")]


@pytest.mark.parametrize("longest, bits", [(2, None), (3, None), (3, 6), (4, 8)])
def test_against_brute_force(spark, longest, bits):
    """All counts and scores, also when nearly all buckets collide."""
    rows = texts(longest, 150) + ODD
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "lang string, text string, n long, phrase string").repartition(3)
    got = co.collocations(df, longest, bits=bits).collect()
    assert {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got} == (want := brute(rows, longest)) and len(got) == len(want) > 20


def test_blocks_add_up(spark, monkeypatch):
    """Counts don't depend on how texts fall into blocks and tasks."""
    rows = texts(9, 120)
    df = spark.createDataFrame(rows, "lang string, text string")
    one = sorted(map(tuple, co.collocations(df.coalesce(1)).collect()))
    monkeypatch.setattr(co, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, co.collocations(df.repartition(7)).collect())) == one


def test_ranks(spark):
    """Ties go to the higher count, then to the first in byte order; ranks count from 1 in each language."""
    rows = [("en", f"p{k}", a, 1, 1, 1, s) for k, (a, s) in enumerate([(10, 5), (11, 5), (10, 5), (10, 9)])] + [("de", "é", 1, 1, 1, 1, 1), ("de", "z", 1, 1, 1, 1, 1), ("de", "Z", 1, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    got = {(r["lang"], r["rank"]): r["phrase"] for r in co.top_collocations(df, 3).collect()}
    assert got == {("en", 1): "p3", ("en", 2): "p1", ("en", 3): "p0", ("de", 1): "Z", ("de", 2): "z", ("de", 3): "é"}


def test_products_pass_64_bits(spark):
    """Scores of counts whose products need more than 64 bits."""
    big = 10**13 + 7
    words = spark.createDataFrame([("en", "a", big + 5), ("en", "b", big + 9)], "lang string, phrase string, f long")
    pairs = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, f long")
    assert co.scored([words, pairs], 2).first()["score"] == 1_000_000 * big * big // ((big + 5) * (big + 9))


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert co.top_collocations(co.collocations(df)).count() == 0


def test_bucket_counts_stop_without_loss():
    """Counts that stop at `least` in each task still reach it together."""
    added = co._added(10, 8)
    part = lambda n: pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([pa.compress(np.full(256, n, np.uint8).tobytes(), "zstd", asbytes=True)])], names=["chunk", "buckets"])
    bits = lambda *n: set(next(added(iter([part(x) for x in n])))[1][0].as_py())
    assert bits(4, 5) == {0} and bits(4, 6) == {255} and bits(10, 10, 10) == {255}


def test_query_agrees_with_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.sql(co.OP13_SQL)
    got = co.op13_collocations(spark, data).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) > 100
