import re
from collections import Counter

import pytest

from breezeframe.plans import QUERIES

SPACES = re.compile(r"[ \t\n\x0b\f\r]+")
LANGS = ("en", "de", "fr", "es", "ja", None)
TEXTS = (
    "Kurz und gut.",
    "perhaps " * 36 + "so",
    "Generally it is Straße 7 " + "wort " * 35,
    "mot " * 90,
    "Une phrase. " + "éà " * 60,
    "ser " * 38 + "más 501 now!!",
    "ser " * 38 + "x501 v1.900 and 500",
    "ser " * 38 + "at 12.5 and 9000.25 end",
    "",
    None,
)


def pieces(text):
    return [w for w in SPACES.split(text) if w]


def defects(text):
    if text is None:
        return []
    n, out = len(pieces(text)), []
    out += ["too_short"] * (n < 35) + ["too_long"] * (n > 80)
    out += ["hedging"] * bool(re.search(r"\b(generally|more or less|it seems|perhaps)\b", text.lower(), re.A))
    out += ["shouting"] * ("!!" in text)
    out += ["number_out_of_range"] * any(float(x) > 500 for x in re.findall(r"(?<![\w.])(\d+(?:\.\d+)?)", text, re.A))
    return out


def trimmed(text):
    if text is None:
        return None
    w = pieces(text)
    head = " ".join(w[:40])
    whole = re.match(r"^(.*[.!?])", head)
    return " ".join(w) if len(w) <= 40 else whole[1] if whole else head + "..."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("records"))
    rows = [(k * 10 + i, t, lang) for k, lang in enumerate(LANGS) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    vectors = [(1, [0.5, 0.1, 0.2, 0.0, 0.0, 0.0, 0.0, -0.75]), (2, [0.25, -1.5]), (3, [0.0] * 63 + [-0.5])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder, [(i, t) for i, t, _ in rows]


def test_texts_of_every_language(spark, tables):
    folder, rows = tables
    assert {r["doc_id"]: r["short"] for r in QUERIES["trimmed_texts_all"](spark, folder).collect()} == {i: trimmed(t) for i, t in rows}
    assert {r["doc_id"]: r["codes"] for r in QUERIES["text_defects_all"](spark, folder).collect()} == {i: ",".join(defects(t)) for i, t in rows}


def test_every_code_is_counted(spark, tables):
    folder, rows = tables
    want = Counter(c for _, t in rows for c in defects(t))
    assert len(want) == 5
    assert {r["code"]: r["n"] for r in QUERIES["defect_counts_all"](spark, folder).collect()} == want


def test_whole_vectors(spark, tables):
    got = {r["vec_id"]: (r["top"], r["best"]) for r in QUERIES["argmax_vector_all"](spark, tables[0]).collect()}
    assert got == {1: (7, 0.75), 2: (1, 1.5), 3: (63, 0.5)}
