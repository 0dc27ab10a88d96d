"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each rule is a ratio of two counts, in 1,024ths. A ratio's sketch is a histogram of bins
of a bounded relative error: ratios below 2 have bins of 1/1024, and each octave above has
1,024 bins, without an upper end. Sketches merge by adding counts, in any order. The
sketch of each language and source gives quartiles; a document breaks a rule when its ratio
lies beyond the upper fence, Q3 + 6 (Q3 - Q1), or the lower one where a rule has it,
and beyond the rule's least distance from the median, so that sources of even
quality reject nothing. Groups of under 40 documents use their language's
sketch, and languages of under 40 the sketch of all.

Nulls and ties: a null text has no words and fails the base rules; a null lang or
source is a group of its own; repeated rows are judged alike; a very long text is read
whole. An empty table gives an empty result. Extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_or_shuffled, stored, table

#: name: (numerator, denominator, has an upper fence, has a lower fence, least distance from the median in 1,024ths)
RULES = {
    "word_length": ("word_chars", "n_words", True, True, 2048),
    "symbols": ("n_symbols", "n_words", True, False, 205),
    "dup_lines": ("n_dup_lines", "n_lines", True, False, 307),
    "repeat_words": ("n_repeat_words", "n_words", True, False, 205),
}
#: Bins of an octave.
BINS = 1024
#: A fence that no ratio passes.
NO_FENCE = 1 << 62
FENCE = 6
LEAST_GROUP = 40
MIN_WORDS = 50
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
SYMBOLS = b"#*$%&|<>"


def text_stats(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word) of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0
    spaces = sum(map(raw.count, b" \t\n\x0b\x0c\r"))
    word_chars = len(text) - spaces
    symbols = sum(map(raw.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    pairs = ids[:-1] * v + ids[1:]
    if v >= 1 << 21:  # then three numbers do not fit in one
        pairs, v = np.unique(pairs, return_inverse=True)[1], v
        windows = np.unique(np.stack([pairs[:-1], ids[2:]]), axis=1, return_inverse=True)[1].ravel()
    else:
        windows = pairs[:-1] * v + ids[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = np.array([text_stats(x.as_py() or "") for x in batch.column("text")], np.int64).reshape(-1, 6)
        rest = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, *map(pa.array, stats.T)], names=[*rest.schema.names, *(x.split()[0] for x in STATS.split(", "))])


def with_stats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, lang, source, text) with the counts of STATS in place of the text."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return narrow.mapInArrow(_stats, f"doc_id long, lang string, source string, {STATS}")


def ratio(top: str, bottom: str) -> Column:
    """The ratio in 1,024ths, rounded down."""
    return F.floor(F.col(top) * BINS / F.greatest(F.col(bottom), F.lit(1))).cast("long")


def ratio_bin(q: Column) -> Column:
    """The bin of a ratio in 1,024ths: itself below 2,048, then 1,024 for each doubling."""
    above = F.greatest(F.length(F.bin(q)) - 11, F.lit(0))
    return (above * BINS).cast("long") + F.call_function("shiftright", q, above)


def bin_ratio(b: Column) -> Column:
    """The least ratio in 1,024ths of a bin."""
    above = F.greatest(F.floor(b / BINS) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (b - above * BINS).cast("long"), above)


def sketches(stats: DataFrame) -> DataFrame:
    """(level, lang, source, rule, bin, n): histograms of each language and source, of each language, and of all.

    The coarser levels merge the finer ones; only documents with words count.
    """
    bins = F.array(*[F.struct(F.lit(k).alias("rule"), ratio_bin(ratio(r[0], r[1])).alias("bin")) for k, r in RULES.items()])
    fine = stats.where("n_words > 0").select("lang", "source", F.explode(bins).alias("_b")).groupBy("lang", "source", "_b.rule", "_b.bin").agg(F.count("*").alias("n"))
    # Nulls are groups: a mark beside each name tells a null from a level's blank.
    fine = fine.select(F.lit(0).alias("level"), *group_key("lang", "lang"), *group_key("source", "source"), "rule", "bin", "n")
    middle = fine.groupBy("lang", "rule", "bin").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", F.lit("").alias("source"), "rule", "bin", "n")
    coarse = middle.groupBy("rule", "bin").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), F.lit("").alias("lang"), F.lit("").alias("source"), "rule", "bin", "n")
    return fine.unionByName(middle).unionByName(coarse)


def group_key(column: str, name: str) -> list[Column]:
    return [F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("null")).alias(name)]


def thresholds(hist: DataFrame) -> DataFrame:
    """(level, lang, source, docs, rule_low, rule_high for each rule): fences from the sketches' quartiles."""
    by = ["level", "lang", "source", "rule"]
    upto = F.sum("n").over(W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(W.partitionBy(*by))
    q = hist.withColumn("_upto", upto).withColumn("_total", total)
    at = lambda share: bin_ratio(F.min(F.when(F.col("_upto") * 4 >= F.col("_total") * share, F.col("bin"))))
    q = q.groupBy(*by).agg(F.max("_total").alias("docs"), at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"))
    columns = []
    for k, (_, _, high, low, least) in RULES.items():
        here = F.col("rule") == k
        up = F.greatest(F.col("q3") + FENCE * (F.col("q3") - F.col("q1")), F.col("q2") + least)
        down = F.least(F.col("q1") - FENCE * (F.col("q3") - F.col("q1")), F.col("q2") - least)
        columns += [F.max(F.when(here, up if high else F.lit(NO_FENCE))).alias(f"{k}_high"), F.max(F.when(here, down if low else F.lit(-1))).alias(f"{k}_low")]
    return q.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *columns)


def judged(stats: DataFrame, fences: DataFrame) -> DataFrame:
    """stats with base_failed, broken (names of the adaptive rules broken) and kept."""
    names = [f"{k}_{s}" for k in RULES for s in ("high", "low")]

    def level(k: int, keys: list[str]) -> DataFrame:
        fits = (F.col("level") == k) & ((F.col("docs") >= LEAST_GROUP) | F.lit(k == 2))
        return fences.where(fits).select(*[F.col(x).alias(f"_{x}") for x in keys], *[F.col(x).alias(f"_{k}_{x}") for x in names])

    out = stats.withColumns({"_lang": group_key("lang", "x")[0], "_source": group_key("source", "x")[0]})
    out = out.join(small_or_shuffled(level(0, ["lang", "source"])), ["_lang", "_source"], "left")
    out = out.join(small_or_shuffled(level(1, ["lang"])), "_lang", "left")
    out = out.join(F.broadcast(level(2, [])), F.lit(True), "left")  # one row
    fence = lambda x: F.coalesce(*[F.col(f"_{k}_{x}") for k in range(3)])
    broken = [F.when((ratio(r[0], r[1]) > fence(f"{k}_high")) | (ratio(r[0], r[1]) < fence(f"{k}_low")), F.lit(k)) for k, r in RULES.items()]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(*stats.columns, failed.alias("base_failed"), F.array_compact(F.array(*broken)).alias("broken")).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def apply_rules(docs: DataFrame) -> DataFrame:
    stats = stored(with_stats(docs), "quality-stats")
    return judged(stats, stored(thresholds(sketches(stats)), "quality-fences"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken", ",").alias("broken"))


def _ratio_sql(top: str, bottom: str) -> str:
    return f"({top} * {BINS} // greatest({bottom}, 1))"


def _bin_sql(q: str) -> str:
    above = f"greatest(length(bin({q}::BIGINT)) - 11, 0)"
    return f"{above} * {BINS} + ({q}::BIGINT >> {above})"


def _value_sql(b: str) -> str:
    above = f"greatest({b} // {BINS} - 1, 0)"
    return f"(({b} - {above} * {BINS})::BIGINT << {above})"


def oracle_sql() -> str:
    """The same counts, histograms and fences in SQL."""
    long = " UNION ALL ".join(f"SELECT lg, sr, '{k}' AS rule, {_bin_sql(_ratio_sql(r[0], r[1]))} AS bin FROM g WHERE n_words > 0" for k, r in RULES.items())
    cases = []
    for k, (_, _, high, low, least) in RULES.items():
        up = f"greatest(q3 + {FENCE} * (q3 - q1), q2 + {least})" if high else str(NO_FENCE)
        down = f"least(q1 - {FENCE} * (q3 - q1), q2 - {least})" if low else "-1"
        cases.append(f"max(CASE WHEN rule = '{k}' THEN {up} END) AS {k}_high, max(CASE WHEN rule = '{k}' THEN {down} END) AS {k}_low")
    names = [f"{k}_{s}" for k in RULES for s in ("high", "low")]
    pick = ", ".join(f"coalesce(a.{x}, b.{x}, c.{x}) AS {x}" for x in names)
    broken = ", ".join(f"CASE WHEN {_ratio_sql(r[0], r[1])} > {k}_high OR {_ratio_sql(r[0], r[1])} < {k}_low THEN '{k}' END" for k, r in RULES.items())
    word = r"[^\x20\x09-\x0D]+"
    at = lambda share: _value_sql(f"min(CASE WHEN upto * 4 >= total * {share} THEN bin END)")
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
         coalesce(regexp_extract_all(text, '{word}'), []) AS w FROM documents),
win AS (
  SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(3) t(k) GROUP BY rid),
lin AS (
  SELECT rid, count(*) AS n_lines, count(DISTINCT l) AS u
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{word}') GROUP BY rid),
g AS (
  SELECT d.rid, doc_id, coalesce('=' || lang, 'null') AS lg, coalesce('=' || source, 'null') AS sr,
         len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         CASE WHEN len(w) = 0 THEN 0 ELSE len(regexp_extract_all(text, '[#*$%&|<>]')) END::BIGINT AS n_symbols,
         coalesce(n_lines - u, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN cov ON d.rid = cov.rid LEFT JOIN lin ON d.rid = lin.rid),
h AS ({long}),
s AS (
  SELECT 0 AS level, lg, sr, rule, bin, count(*) AS n FROM h GROUP BY ALL
  UNION ALL SELECT 1, lg, '', rule, bin, count(*) FROM h GROUP BY ALL
  UNION ALL SELECT 2, '', '', rule, bin, count(*) FROM h GROUP BY ALL),
u AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lg, sr, rule ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lg, sr, rule) AS total FROM s),
q AS (
  SELECT level, lg, sr, rule, max(total) AS docs, {at(1)} AS q1, {at(2)} AS q2, {at(3)} AS q3
  FROM u GROUP BY ALL),
f AS (SELECT level, lg, sr, max(docs) AS docs, {", ".join(cases)} FROM q GROUP BY ALL),
j AS (
  SELECT g.*, {pick} FROM g
  LEFT JOIN f a ON a.level = 0 AND a.docs >= {LEAST_GROUP} AND a.lg = g.lg AND a.sr = g.sr
  LEFT JOIN f b ON b.level = 1 AND b.docs >= {LEAST_GROUP} AND b.lg = g.lg
  LEFT JOIN f c ON c.level = 2),
v AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, array_to_string(list_filter([{broken}], lambda x: x IS NOT NULL), ',') AS broken FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM v
"""


OP2_SQL = oracle_sql()
