"""Phrase collocations by hashed bucket counts and Apriori pruning.

Texts are lower-cased (A-Z), cut at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words
`[^\\x20\\x09]+`. A phrase of n words is counted wherever its words stand next to each other in a
piece, for each language on its own.

Pass n reads all texts once. It counts the phrases of n words exactly and, on the way, adds up how often
each hash bucket of the phrases of n + 1 words occurs:

1. A task counts buckets for all its texts in one array of bytes that stop at `least`, and sends it in
   compressed chunks; the chunks are added as they stream through the tasks they are dealt to.
   Buckets that reach `least` make a bitmap.
2. The next pass is sent this bitmap and one of the hashes of the frequent phrases of n words. It
   counts a phrase of n + 1 words only if its bucket is set (PCY, DHP) and the phrases of
   its first and last n words are (Apriori). Bitmaps can only let too much through, so
   the counts of frequent phrases are exact whatever collides.
3. Tasks count a block of texts at a time with numbers for its words, and Spark adds the blocks' counts by phrase.

A bitmap has 2^`bits` bits, which follow the size of the corpus between `MIN_BITS` and `MAX_BITS`: 8 MB at most are
broadcast, and a task's byte array is 64 MB at most.

Scores are exact: products are decimals of 38 digits, enough for counts up to 10^16.

Nulls and ties: a null text is empty; a null lang counts as `und`, together with texts that say so; doc_id
isn't read, so null or repeated ids change nothing, and repeated rows count each time. A very long text is
a block of its own. An empty table gives an empty result. Extra columns are ignored,
whatever their names. Equal cut scores go to the earliest cut, equal phrase scores to the higher count and then
to the phrase that is first in byte order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored, table
from .packing import slices

LONGEST, LEAST, TOP = 3, 10, 2000
#: A candidate goes if a longer one that holds it has this share of its count, in per cent.
SHARE = 50
SALTS = 64
MIN_BITS, MAX_BITS = 16, 26
#: Bytes of text for each bucket: of five to six characters a word, some eight phrases come to a bucket.
BUCKET_BYTES = 48
#: Buckets are sent in chunks of this many.
CHUNK = 1 << 16
#: Bytes of text that are counted together.
BLOCK_BYTES = 8 << 20
SPLIT = r"[.,;:!?\x0A-\x0D]+"
COUNTS = "lang string, phrase string, hash long, n long, chunk int, buckets binary"
#: Odd numbers that mix the hashes of words into those of phrases.
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# --- blocks of texts


def word_codes(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of texts as numbers into an array of words, -1 between pieces and after each text."""
    spaced = pc.replace_substring_regex(pc.ascii_lower(texts), SPLIT, " . ")
    ended = pc.binary_join_element_wise(spaced, pa.scalar(".", spaced.type), pa.scalar(" ", spaced.type))
    found = pc.ascii_split_whitespace(ended).flatten()
    words = found.filter(pc.not_equal(found, "")).dictionary_encode()
    codes, names = words.indices.to_numpy().astype(np.int64), words.dictionary
    end = pc.index(names, pa.scalar(".", names.type)).as_py()
    codes[codes == end] = -1
    return codes, names


def word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    """64 bits of each word and its language; the same in every task."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) ^ pd.util.hash_array(np.array([lang], object), categorize=False) * STEP


def mixed(hashes: np.ndarray, codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """64 bits of the phrases of n words that begin at `at`."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out ^ hashes[codes[at + k]]) * MIX
        out ^= out >> np.uint64(29)
    return out


def is_set(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    bucket = hashes >> np.uint64(64 - bits)
    return (bitmap[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8)) & 1 == 1


def whole_phrases(codes: np.ndarray, n: int) -> np.ndarray:
    """Where n words follow each other within a piece."""
    held = codes >= 0
    inside = held[: max(0, len(codes) - n + 1)].copy()
    for k in range(1, n):
        inside &= held[k : len(codes) - n + 1 + k]
    return np.flatnonzero(inside)


def counted(codes: np.ndarray, at: np.ndarray, n: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each different phrase of n words stands first, how often it stands at `at`)."""
    key = codes[at]
    for k in range(1, n):
        if k > 1:  # numbers of the phrases so far, so that keys stay within 64 bits
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * n_words + codes[at + k]
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    return at[first], times


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """(lang, texts) of blocks of some BLOCK_BYTES at most, or one text."""
    held: dict[str, list[pa.Array]] = {}
    size = 0
    for batch in batches:
        for lo, hi in slices(batch.column(1), BLOCK_BYTES):
            langs, texts = batch.column(0)[lo:hi], pc.cast(batch.column(1)[lo:hi], pa.large_string())
            if held and size + texts.nbytes > BLOCK_BYTES:
                yield from ((lang, pa.concat_arrays(held.pop(lang))) for lang in list(held))
                size = 0
            for lang in pc.unique(langs).to_pylist():
                held.setdefault(lang, []).append(texts.filter(pc.equal(langs, lang)))
            size += texts.nbytes
    yield from ((lang, pa.concat_arrays(held.pop(lang))) for lang in list(held))


def _pass(n: int, more: bool, least: int, bits: int, frequent, buckets):
    """The pass over texts (lang, text) that counts phrases of n words and, if there is one more, buckets for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in COUNTS.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        totals = np.zeros(1 << bits, np.uint8) if more else None
        pruned = [np.frombuffer(x.value, np.uint8) for x in (frequent, buckets)] if n > 1 else None
        for lang, texts in _blocks(batches):
            codes, words = word_codes(texts)
            hashes = word_hashes(words, lang)
            at = whole_phrases(codes, n)
            if n > 1:
                shorter = whole_phrases(codes, n - 1)
                good = np.zeros(len(codes) + 1, bool)
                good[shorter] = is_set(pruned[0], mixed(hashes, codes, shorter, n - 1), bits)
                at = at[good[at] & good[at + 1]]
                at = at[is_set(pruned[1], mixed(hashes, codes, at, n), bits)]
            first, times = counted(codes, at, n, len(words))
            phrases = [words.take(pa.array(codes[first + k])) for k in range(n)]
            phrase = pc.cast(phrases[0] if n == 1 else pc.binary_join_element_wise(*phrases, pa.scalar(" ", words.type)), pa.string())
            none = [pa.nulls(len(first), t) for t in types[4:]]
            rows = [pa.array([lang] * len(first), types[0]), phrase, pa.array(mixed(hashes, codes, first, n).view(np.int64)), pa.array(times.astype(np.int64)), *none]
            yield from pa.Table.from_arrays(rows, names=names).to_batches(100_000)
            if more:
                # A phrase can only be frequent if those of its first and last n words may be.
                alive = np.zeros(len(codes) + 1, bool)
                alive[at] = True
                longer = whole_phrases(codes, n + 1)
                longer = longer[alive[longer] & alive[longer + 1]]
                bucket, times = np.unique((mixed(hashes, codes, longer, n + 1) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                totals[bucket] = np.minimum(totals[bucket] + times, least)
        if more:
            chunks = [(k, totals[k * CHUNK : (k + 1) * CHUNK]) for k in range(-(-len(totals) // CHUNK))]
            full = [(k, pa.compress(x.tobytes(), "zstd", asbytes=True)) for k, x in chunks if x.any()]
            none = [pa.nulls(len(full), t) for t in types[:4]]
            yield pa.RecordBatch.from_arrays([*none, pa.array([k for k, _ in full], types[4]), pa.array([x for _, x in full], types[5])], names=names)

    return run


def _added(least: int, bits: int):
    """Chunks (chunk, buckets) of one partition, added as they stream by -> bits of the buckets that reach `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        size = min(CHUNK, 1 << bits)
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(pa.decompress(data.as_py(), size, "zstd", asbytes=True), np.uint8)
                sums[k] = np.minimum(sums[k].astype(np.int16) + x, least).astype(np.uint8) if k in sums else x
        made = [(k, np.packbits(x >= least, bitorder="little").tobytes()) for k, x in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], names=["chunk", "bits"])

    return run


# --- passes


def bucket_bitmap(counts: DataFrame, least: int, bits: int) -> bytes:
    """The buckets that reach `least`: 2^bits bits, gathered from as many chunks as these need."""
    out = np.zeros(1 << bits >> 3, np.uint8)
    size = min(CHUNK, 1 << bits) >> 3
    sums = counts.where("chunk IS NOT NULL").select("chunk", "buckets").repartition("chunk").mapInArrow(_added(least, bits), "chunk int, bits binary").toArrow()
    for k, data in zip(sums.column(0).to_pylist(), sums.column(1).to_pylist()):
        out[k * size : (k + 1) * size] = np.frombuffer(data, np.uint8)
    return out.tobytes()


def hash_bitmap(phrases: DataFrame, bits: int) -> bytes:
    """The buckets of the hashes of phrases: at most 2^(bits - 6) words of 64 bits come to the driver."""
    bucket = F.shiftrightunsigned("hash", 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bucket.bitwiseAND(F.lit(63)).cast("int"))
    found = phrases.groupBy(F.shiftrightunsigned(bucket, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << bits >> 6, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.astype("<i8").tobytes()


def bits_for(texts: DataFrame) -> int:
    """Bits of a bucket's number, by the bytes of the whole corpus."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MAX_BITS, max(MIN_BITS, (size // BUCKET_BYTES).bit_length()))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """([(lang, phrase, f) of the phrases of n words with f >= least, for n from 1], (lang, n) of all words), as stored tables."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bits = bits or bits_for(texts)
    found, totals, sent = [], None, (None, None)
    for n in range(1, longest + 1):
        counts = stored(texts.mapInArrow(_pass(n, n < longest, least, bits, *sent), COUNTS), f"phrases-{n}")
        phrases = counts.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.first("hash").alias("hash"))
        found.append(stored(phrases.where(F.col("f") >= least), f"phrases-{n}-frequent"))
        if n == 1:
            totals = stored(counts.where("phrase IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")), "phrases-words")
        for old in sent:
            if old is not None:
                old.unpersist()
        if n < longest:
            sent = tuple(spark.sparkContext.broadcast(x) for x in (hash_bitmap(found[-1], bits), bucket_bitmap(counts, least, bits)))
        discard(counts)
    return [x.select("lang", "phrase", "f") for x in found], totals


# --- scores


def first_words(phrase: Column, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def last_words(phrase: Column, k: int) -> Column:
    return F.substring_index(phrase, " ", -k)


def scored(found: list[DataFrame], n: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of n words, by their lowest cut."""
    out, cuts = found[n - 1].withColumnRenamed("f", "a"), []
    for k in range(1, n):
        # Parts of a frequent phrase are frequent, so both are always found.
        left = found[k - 1].select("lang", F.col("phrase").alias("_left"), F.col("f").alias(f"l{k}"))
        right = found[n - k - 1].select("lang", F.col("phrase").alias("_right"), F.col("f").alias(f"r{k}"))
        out = out.withColumn("_left", first_words(F.col("phrase"), k)).withColumn("_right", last_words(F.col("phrase"), n - k))
        out = out.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).drop("_left", "_right")
        score = F.expr(f"CAST(CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0)) * 1000000BD DIV (CAST(l{k} AS DECIMAL(19,0)) * CAST(r{k} AS DECIMAL(19,0))) AS BIGINT)")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return out.withColumn("_best", best).select("lang", "phrase", "a", F.col("_best.l").alias("l"), F.col("_best.r").alias("r"), F.col("_best.score").alias("score"))


def inside(found: list[DataFrame], n: int) -> DataFrame:
    """(lang, phrase, longer): the highest count of a longer candidate that holds each phrase of n words."""
    out = None
    for m in range(n + 1, len(found) + 1):
        words = F.split("phrase", " ")
        held = F.array_distinct(F.array(*[F.array_join(F.slice(words, k, n), " ") for k in range(1, m - n + 2)]))
        own = found[m - 1].select("lang", F.explode(held).alias("phrase"), "f")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, bits: int | None = None) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): all candidates of 2 to `longest` words that no longer one takes the place of, as a stored table."""
    found, totals = frequent_phrases(docs, longest, least, bits)
    every = None
    for n in range(2, longest + 1):
        own = scored(found, n)
        if n < longest:
            own = own.join(inside(found, n), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")
        own = stored(own, f"phrases-{n}-scored")
        every = own if every is None else every.unionByName(own)
    # One row a language.
    out = stored(every.join(totals, "lang"), "collocations")
    for part in (*found, totals, every):
        discard(part)
    return out


def top_collocations(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language, with their rank; first those of each of SALTS parts, so that a language's last sort is of SALTS * top rows at most."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = found.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "_s"], ["lang"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return salted.drop("_s").withColumn("rank", F.col("rank").cast("long"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_collocations(collocations(table(spark, sf_dir, "documents"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         list_filter(list_transform(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'),
           lambda x: regexp_extract_all(x, '[^\x20\x09]+')), lambda x: len(x) > 0) AS pieces
  FROM documents),
p AS (SELECT lang, unnest(pieces) AS w FROM d),
g1 AS (SELECT lang, unnest(w) AS phrase FROM p),
g2 AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) AS phrase FROM p),
g3 AS (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS phrase FROM p),
f1 AS (SELECT lang, phrase, count(*)::HUGEINT AS f FROM g1 GROUP BY ALL),
f2 AS (SELECT lang, phrase, count(*)::HUGEINT AS f FROM g2 GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, phrase, count(*)::HUGEINT AS f FROM g3 GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
c AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, 1000000 * c.f * c.f // (x.f * y.f) AS score, 1 AS k
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.phrase = split_part(c.phrase, ' ', 1) JOIN f1 y ON y.lang = c.lang AND y.phrase = split_part(c.phrase, ' ', 2)
  UNION ALL
  SELECT c.lang, c.phrase, c.f, x.f, y.f, 1000000 * c.f * c.f // (x.f * y.f), 1
  FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.phrase = split_part(c.phrase, ' ', 1)
  JOIN f2 y ON y.lang = c.lang AND y.phrase = split_part(c.phrase, ' ', 2) || ' ' || split_part(c.phrase, ' ', 3)
  UNION ALL
  SELECT c.lang, c.phrase, c.f, x.f, y.f, 1000000 * c.f * c.f // (x.f * y.f), 2
  FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.phrase = split_part(c.phrase, ' ', 1) || ' ' || split_part(c.phrase, ' ', 2)
  JOIN f1 y ON y.lang = c.lang AND y.phrase = split_part(c.phrase, ' ', 3)),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2) AS phrase, f FROM f3
    UNION ALL SELECT lang, split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3), f FROM f3) GROUP BY ALL),
o AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * a)
SELECT o.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
