"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key whose rate is its quality weight, so the
order by key within a source is a weighted random order without replacement.
A source takes whole epochs first; the words left of its target go to the
documents that come first in key order, found by prefix sums of sizes.

Prefix sums are made in three levels (coarse key bins, fine bins within them,
documents within a fine bin), so a source with a third of all rows is spread over
as many tasks as its keys have bins and no window holds a whole source.

Nulls and ties: a null text has size 0; a null source is a source of its own,
last in order; a null doc_id draws its key from the text alone. Rows with equal keys
are ordered by doc_id and a text digest; wholly equal rows are interchangeable.
A very long text is one size like any other. An empty table gives an empty result.
Other columns keep their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_or_shuffled, stored, table, word_count

#: Source weights in order of source name, repeating.
SOURCE_WEIGHTS = (5, 2, 1)
#: A target is at most so many times its source's size.
MAX_EPOCHS = 3
SEED = "mix-1"
#: Bins of an octave of keys: coarse, and fine within a coarse one.
COARSE, FINE = 32, 256


def quality_weight(text: Column, size: Column) -> Column:
    """Words over words plus four times the symbols among them, in (0, 1]; 1 without words."""
    symbols = F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>!]")), F.lit(0))
    return F.when(size > 0, size / (size + 4 * symbols)).otherwise(F.lit(1.0)).cast("double")


def exponential_key(doc_id: Column, text: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight with u from the document's id and text, the same in every run.

    Unlike texts under one id, or under none, so draw keys of their own.
    """
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}:"), own).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)
    return -F.ln(u) / weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (_src, source_size), one row a source: its target under the weights, capped and reshared.

    With sources in ascending order of cap over weight, the capped ones are a
    prefix; each source compares its cap with the level that the words left
    give to the weights left, so no loop is needed. Past the last capped source the
    levels fall, so the highest of them is the one that holds.
    """
    order = W.orderBy("_src")
    by_ratio = W.orderBy("_ratio", "_src")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        sizes.withColumn("_w", weight)
        .withColumn("_cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
        .withColumn("_capped", F.col("_ratio") <= F.col("_level"))
        .withColumn("_final", F.max(F.when(~F.col("_capped"), F.col("_level"))).over(every))
        .withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * F.col("_final")))
        .select("_src", "source_size", "target")
    )


def _mixed(docs: DataFrame, seed: str, carried: list[str]) -> DataFrame:
    """(row, size, source_size, target, taken): row holds the carried columns of docs, whose names so clash with none of ours."""
    keyed = (
        docs.select(F.struct(*[docs[c] for c in carried]).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), docs["source"].cast("string").alias("source"))
        .withColumn("size", word_count(F.col("text")))
        .select(
            "row",
            "doc_id",
            "size",
            F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("_src"),
            exponential_key(F.col("doc_id"), F.col("text"), quality_weight(F.col("text"), F.col("size")), seed).alias("_key"),
            F.xxhash64("text").alias("_tie"),
        )
        # Never null, so that the joins below do not test them for it, which would count the words again.
        .withColumn("_fine", F.coalesce(F.floor(F.log2("_key") * (COARSE * FINE)), F.lit(0)))
        .withColumn("_coarse", F.coalesce(F.floor(F.col("_fine") / FINE), F.lit(0)))
    )
    # A small histogram, stored so that the texts are read only once more, for the documents themselves.
    fine = stored(keyed.groupBy("_src", "_coarse", "_fine").agg(F.sum("size").alias("_n")), "key-bins")
    coarse = fine.groupBy("_src", "_coarse").agg(F.sum("_n").alias("_n"))
    targets = source_targets(coarse.groupBy("_src").agg(F.sum("_n").alias("source_size")))
    below = lambda by, o: F.sum("_n").over(W.partitionBy(*by).orderBy(o).rowsBetween(W.unboundedPreceding, -1))
    coarse = coarse.withColumn("_before", F.coalesce(below(["_src"], "_coarse"), F.lit(0))).drop("_n")
    coarse = coarse.join(small_or_shuffled(targets), "_src")
    fine = fine.withColumn("_within", F.coalesce(below(["_src", "_coarse"], "_fine"), F.lit(0))).drop("_n")
    fine = fine.join(coarse, ["_src", "_coarse"]).withColumn("_start", F.col("_before") + F.col("_within")).drop("_before", "_within")
    by_key = W.partitionBy("_src", "_coarse", "_fine").orderBy("_key", "doc_id", "_tie").rowsBetween(W.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    room = F.floor("target") - F.col("_epochs") * F.col("source_size") - F.col("_before")
    return (
        keyed.join(fine, ["_src", "_coarse", "_fine"])
        .withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(by_key), F.lit(0)))
        .withColumn("_epochs", epochs)
        .withColumn("taken", (F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), room))).cast("long"))
        .select("row", *ADDED)
    )


ADDED = ("size", "source_size", "target", "taken")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs (doc_id, text, source and any other columns) with size, source_size, target and taken.

    Columns of docs that clash with these four names are replaced.
    """
    keep = [c for c in docs.columns if c not in ADDED]
    return _mixed(docs, seed, keep).select(*[F.col("row")[c].alias(c) for c in keep], *ADDED)


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix as rows of docs: a document appears once for each time that it is taken whole.

    Where a target ends inside a document, it stays if at least half of its words are taken.
    """
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(F.lit(0)).cast("int")
    mixed = _mixed(docs, seed, docs.columns).withColumn("_times", F.explode(F.array_repeat(F.lit(1), times)))
    return mixed.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return _mixed(docs, SEED, ["doc_id"]).select("row.doc_id", *ADDED)


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         coalesce(len(regexp_extract_all(text, '[#*$%&|<>!]')), 0) AS symbols
  FROM documents),
k AS (
  SELECT doc_id, source, size, md5(coalesce(text, '')) AS tie,
         -ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1:' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
           / (CASE WHEN size > 0 THEN size::DOUBLE / (size + 4 * symbols) ELSE 1.0 END) AS key
  FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
s1 AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM s0),
s2 AS (
  SELECT *, cap / w AS ratio,
         ((SELECT sum(source_size) FROM s0)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
           / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s1),
s3 AS (
  SELECT source, source_size,
         CASE WHEN ratio <= level THEN cap ELSE w * (SELECT max(level) FROM s2 WHERE ratio > level) END AS target
  FROM s2),
e AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM s3),
t AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
         floor(e.target)::BIGINT - e.epochs * e.source_size
           - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(0, least(size, room)))::BIGINT AS taken FROM t
"""
