import hashlib
import random
from collections import Counter, defaultdict

import pytest

from breezeframe.llm import alignment as al


@pytest.fixture(scope="module")
def own():
    return al.Tokens(*al.tokenizer_paths())


def brute(own, texts):
    """For each text, what the query returns: whole texts encoded at once, plain loops over their tokens."""
    parsed, counts = [], Counter()
    for text in texts:
        text, links, groups = text or "", [], []
        a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
        spans = []
        for ids, of in ((a, own.bytes_a), (b, own.bytes_b)):
            at, found = 0, []
            for i in ids:
                found.append((i, at, at := at + len(of[i])))
            spans.append(found)
        raw = (" " + text).encode()
        if not text or any(b"".join(of[i] for i in ids) != raw for ids, of in ((a, own.bytes_a), (b, own.bytes_b))):
            parsed.append(None)
            continue
        k = 0
        for i, lo, hi in spans[0]:
            while spans[1][k][2] <= lo:
                k += 1
            m = k
            while m < len(spans[1]) and spans[1][m][1] < hi:
                links.append((i, spans[1][m][0]))
                m += 1
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        low = 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, lo, hi in side if low <= lo and hi <= cut) for side in spans))
            low = cut
        counts.update(links)
        parsed.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if p is None else (*p[:3], len(p[3]), sum(counts[x] == most[x[1]] for x in p[3]), sum(counts[x] for x in p[3]), p[4]) for p in parsed]


ODD = [
    None, "", " ", "  ", "\n", " a", "a ", "a  b", "a\n\nb\n c", "\n\n L", " \n L.", "x.y,z", "...a", "don't you'll 's 'sx", "U+2581 ▁ here the end", "▁",
    "nul \x00 byte. and more", "\x00", "<|endoftext|> a <s> b</s> <unk> <0x41>", "é è. ÿ,Ö", "é ﬁ", "日本語 の文。 text", "🙂 ok 🙂🙂", "a\tb\r\nc d   e", "1 2.3,4 a1 b-2 (c)", "http://a.b/c?d=e&f", "tail,", "the end the end the end the",
    "x" * 5000, "word " * 3000, "no-cuts-" * 2000,
]


def test_segments_join_to_texts():
    numbers, segments, counts = al.segmented(al.pa.array([t or "" for t in ODD]))
    at, parts = 0, segments.to_pylist()
    for text, n in zip(ODD, counts.tolist()):
        assert "".join(parts[k] for k in numbers[at : at + n]) == (" " + text if text else "")
        at += n


def test_segments_have_the_tokens_of_whole_texts(own):
    """Random texts over letters, marks and odd characters: both tokenizers give a text the ids of its segments."""
    rng = random.Random(5)
    parts = ["a", "The", "é", "ing", " ", " ", " ", ".", ",", "\n", "'s", "'", "-", "1", "\t", "  ", "ß", "語", " ", "!", "\r"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    numbers, segments, counts = al.segmented(al.pa.array(texts))
    ids_a, ids_b = own.encode(segments.to_pylist())
    at = 0
    for text, n in zip(texts, counts.tolist()):
        mine = numbers[at : at + n].tolist()
        assert [i for k in mine for i in ids_a[k]] == own.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for k in mine for i in ids_b[k]] == own.b.encode(text)
        at += n


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_against_brute_force(spark, own, monkeypatch, block):
    monkeypatch.setattr(al, "BLOCK_BYTES", block)
    rng = random.Random(block)
    words = ["alignment", "tokens", "Überraschung", "l'été", "can't", "end.", "a,b", "x" * 9, "42", "naïve"]
    texts = [*ODD, *[" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(60)], "the same", "the same"]
    rows = [(k if k % 9 else None, t, 1, 2) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, block long").repartition(3)
    got = sorted((tuple(r) for r in al.document_digests(df).collect()), key=str)
    want = sorted(((i, *x) for (i, *_), x in zip(rows, brute(own, texts))), key=str)
    assert got == want


def test_links_and_groups_by_hand(spark):
    """A: [2, 3, 1] bytes, B: [2, 1, 3]: cuts at 2 and 6; the second group has three links."""
    tokens = spark.createDataFrame([(7, 3, [1, 2, 3, 4, 5, 6], [2, 3, 1, 2, 1, 3])], "sid long, first_b int, ids array<int>, lengths array<int>")
    got = al.aligned(tokens).first()
    assert got["groups"] == "1|4;2,3|5,6" and (got["n_a"], got["n_b"], got["n_groups"], got["n_links"]) == (3, 3, 2, 4)
    assert sorted((x >> 32, x & 0xFFFFFFFF) for x in got["links"]) == [(1, 4), (2, 5), (2, 6), (3, 6)]


def test_spoiled_texts_do_not_count(spark, own):
    """A text with a character that B reads as a space adds nothing to the counts of its other tokens."""
    texts = ["the end", "the end ▁", "the end", "the other"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["count_sum"] for r in al.document_digests(df).collect()}
    assert got[1] == 0 and got[0] == got[2] == brute(own, texts)[0][5] == 3 + 2


def test_empty(spark):
    assert al.document_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, own):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: x for r, x in zip(docs, brute(own, [r["text"] for r in docs]))}
    got = al.op12_alignment(spark, data).collect()
    assert len(got) == len(docs) and {r[0]: tuple(r)[1:] for r in got} == want
