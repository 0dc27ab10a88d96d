"""Queries that hold stored results against what they come from, and read archives by month and by age."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import adapters as ad
from .hourly import query, rounded

# The dimensions that a judge scores, each from 0 to 2, and the names that an entry's id goes by.
DIMENSIONS = ("actionable_time", "place_specificity", "safety_caveat", "length", "sensory_cue")
IDS = ("id", "ID", "anon_id")


# --- snapshots by month


def write_snapshots(rows: DataFrame, when: str, folder: str) -> None:
    """rows in folders by year and month of the column `when`."""
    rows.withColumns({"year": F.year(when), "month": F.month(when)}).repartition("year", "month").write.partitionBy("year", "month").parquet(folder)


def snapshots(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All snapshots of a folder; an empty frame where there is no folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = StructType.fromDDL("year int, month int")
    whole = StructType(list(schema.fields) + list(whole.fields))
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(folder)


def load_snapshot(spark: SparkSession, folder: str, schema: StructType, year: int, month: int) -> DataFrame:
    """The rows of one month: only its folder is listed and read, and a month without one has no rows."""
    return snapshots(spark, folder, schema).where((F.col("year") == year) & (F.col("month") == month)).drop("year", "month")


def _shipments(spark, d):
    """A folder of monthly snapshots of all shipments, and their schema."""
    folder = f"{ad.shared_folder(spark)}/{spark.sparkContext.applicationId}/snapshots-{uuid.uuid4().hex}"
    rows = ad.table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_shipdate")
    write_snapshots(rows, "l_shipdate", folder)
    return folder, rows.schema


@query("SELECT year(l_shipdate)::INTEGER AS year, month(l_shipdate)::INTEGER AS month, count(*)::BIGINT AS n, count(DISTINCT l_partkey)::BIGINT AS kinds FROM lineitem GROUP BY ALL")
def snapshot_months(spark, d):
    """The months that have a snapshot and what is in them."""
    folder, schema = _shipments(spark, d)
    return snapshots(spark, folder, schema).groupBy("year", "month").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("kinds"))


@query("""SELECT l_partkey AS taxon, count(*)::BIGINT AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem
WHERE date_trunc('month', l_shipdate) = (SELECT date_trunc('month', max(l_shipdate)) FROM lineitem) GROUP BY l_partkey""")
def newest_snapshot(spark, d):
    """The last month's snapshot by kind, and the month after it, which has none and adds no row."""
    folder, schema = _shipments(spark, d)
    last = snapshots(spark, folder, schema).agg(F.max(F.struct("year", "month")).alias("m")).first()["m"]
    year, month = (last["year"], last["month"]) if last else (1970, 1)
    following = (year + month // 12, month % 12 + 1)
    rows = load_snapshot(spark, folder, schema, year, month).unionByName(load_snapshot(spark, folder, schema, *following))
    return rows.groupBy(F.col("l_partkey").alias("taxon")).agg(F.count("*").alias("n"), rounded(F.sum("l_quantity"), 4).alias("quantity"))


def newest_file(spark: SparkSession, folder: str, pattern: str, kind: str = "parquet") -> DataFrame:
    """(path, name, modified) of the newest of the files whose name fits a glob; of equal times the last name. No row if none fits.

    One row of the source's own metadata stands for each file, so no content but its first row group's is read.
    """
    files = spark.read.format(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    own = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("modified"))
    newest = own.groupBy().agg(F.max(F.struct("modified", "name", "path")).alias("m")).where("m IS NOT NULL")
    return newest.select("m.path", "m.name", "m.modified")


# --- stored summaries against what they sum up


def disagreements(derived: DataFrame, stored: DataFrame, key: str, measures: dict[str, float]) -> DataFrame:
    """(key, code, derived, stored): a row for each way in which two tables of one row a key disagree, from both sides.

    `missing_summary` and `missing_rows` for a key that only one side has, `repeated` for one that a side has twice, and
    `wrong_<measure>` where both have a value and they are further apart than the tolerance, or only one has it.
    """
    side = lambda df, name: df.groupBy(key).agg(F.struct(F.count("*").alias("_rows"), *[F.max(m).cast("double").alias(m) for m in measures]).alias(name))
    both = side(derived, "a").join(side(stored, "b"), key, "full")
    found = lambda bad, code, x, y: F.when(bad, F.struct(F.lit(code).alias("code"), x.cast("double").alias("derived"), y.cast("double").alias("stored")))
    a, b = F.col("a"), F.col("b")
    one = [found(b.isNull(), "missing_summary", a["_rows"], b["_rows"]), found(a.isNull(), "missing_rows", a["_rows"], b["_rows"]), found((a["_rows"] > 1) | (b["_rows"] > 1), "repeated", a["_rows"], b["_rows"])]
    differ = lambda m, by: a.isNotNull() & b.isNotNull() & (F.coalesce(F.abs(a[m] - b[m]) > by, a[m].isNull() != b[m].isNull()))
    return both.select(key, F.inline(F.array_compact(F.array(*one, *[found(differ(m, by), f"wrong_{m}", a[m], b[m]) for m, by in measures.items()]))))


@query("""WITH a AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_extendedprice) AS t FROM lineitem WHERE l_orderkey % 97 <> 5 GROUP BY 1),
b AS (SELECT o_orderkey AS k, max(1 + o_orderkey % 7) AS n, max(o_totalprice) AS t FROM orders WHERE o_orderkey % 89 <> 7 GROUP BY 1),
j AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS ha, b.k IS NOT NULL AS hb, a.n AS an, b.n AS bn, a.t AS ta, b.t AS tb FROM a FULL JOIN b ON a.k = b.k)
SELECT code, count(*)::BIGINT AS n, count(DISTINCT k)::BIGINT AS keys FROM (
SELECT k, 'missing_summary' AS code FROM j WHERE NOT hb UNION ALL SELECT k, 'missing_rows' FROM j WHERE NOT ha
UNION ALL SELECT k, 'wrong_n' FROM j WHERE ha AND hb AND an <> bn UNION ALL SELECT k, 'wrong_total' FROM j WHERE ha AND hb AND abs(ta - tb) > 0.005) GROUP BY code""")
def summary_disagreements(spark, d):
    """Orders as stored summaries of their lines; every 97th key has lost its lines and every 89th its summary."""
    lines, orders = ad.table(spark, d, "lineitem"), ad.table(spark, d, "orders")
    derived = lines.where("l_orderkey % 97 <> 5").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("total"))
    stored = orders.where("o_orderkey % 89 <> 7").select(F.col("o_orderkey").alias("k"), (1 + F.col("o_orderkey") % 7).alias("n"), F.col("o_totalprice").alias("total"))
    return disagreements(derived, stored, "k", {"n": 0, "total": 0.005}).groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("k").alias("keys"))


# --- what a judge answers


def judge_scores(answers: DataFrame) -> DataFrame:
    """(key, answer) -> (key, id, the DIMENSIONS, total): scores of JSON that is a list of entries, a map of them by id, one entry, or has any of these as `scores`.

    Entries that are no objects and those without an id go; of entries with one id the last counts. A value that is no
    number is null; others are cut to whole numbers between 0 and 2. Text that is no JSON has no rows.
    """
    v = F.try_parse_json("answer")
    kind = lambda x: F.schema_of_variant(x)
    is_object = lambda x: F.coalesce(kind(x).startswith("OBJECT"), F.lit(False))
    listed, mapped = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>")
    scores = F.try_variant_get(v, "$.scores", "array<variant>")
    entry = lambda own, x: F.struct(own.alias("own"), x.alias("v"))
    none = F.lit(None).cast("string")
    plain = lambda xs: F.transform(xs, lambda x: entry(none, x))
    by_id = F.transform(F.map_entries(mapped), lambda e: entry(e["key"], e["value"]))
    entries = (
        F.when(kind(v).startswith("ARRAY"), plain(listed))
        .when(is_object(v) & scores.isNotNull(), plain(scores))
        .when(is_object(v) & (F.size(mapped) > 0) & F.forall(F.map_values(mapped), is_object), by_id)
        .when(is_object(v), F.array(entry(none, v)))
    )
    rows = answers.select("key", F.posexplode(entries).alias("at", "e")).where(is_object(F.col("e.v")))
    text = lambda name: F.nullif(F.nullif(F.try_variant_get("e.v", f"$.{name}", "string"), F.lit("")), F.lit("0"))
    rows = rows.withColumn("id", F.coalesce("e.own", *map(text, IDS))).where("id IS NOT NULL AND id <> ''")

    def score(name: str) -> Column:
        own = F.try_variant_get("e.v", f"$.{name}", "variant")
        number = kind(own).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")
        whole = F.try_variant_get("e.v", f"$.{name}", "double")
        return F.when(number, F.greatest(F.lit(0), F.least(F.lit(2), F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole)))).cast("int")).when(kind(own) == "BOOLEAN", F.try_variant_get("e.v", f"$.{name}", "boolean").cast("int"))

    made = rows.select("key", "id", "at", *[score(n).alias(n) for n in DIMENSIONS])
    last = made.groupBy("key", "id").agg(F.max_by(F.struct(*DIMENSIONS), "at").alias("s")).select("key", "id", "s.*")
    return last.withColumn("total", reduce(lambda a, b: a + b, [F.coalesce(n, F.lit(0)) for n in DIMENSIONS]))


_RAW = [f"round_even(embedding[{k + 1}]::DOUBLE * 20, 1)" for k in range(5)]
_CUT = [f"greatest(0, least(2, CAST(trunc({x}) AS INTEGER)))" for x in _RAW[:3]]


@query(f"""WITH s AS (SELECT vec_id, {', '.join(f'{x} AS {n}' for x, n in zip(_CUT, DIMENSIONS))}, NULL::INTEGER AS length, (vec_id % 3)::INTEGER AS sensory_cue FROM embeddings WHERE vec_id % 6 <> 5)
SELECT vec_id AS key, CASE WHEN vec_id % 6 = 1 THEN 'm' || vec_id ELSE 'a' || vec_id END AS id, {', '.join(DIMENSIONS)}, {' + '.join(f'coalesce({n}, 0)' for n in DIMENSIONS)} AS total FROM s
UNION ALL SELECT vec_id, 'b' || vec_id, {', '.join(DIMENSIONS)}, {' + '.join(f'coalesce({n}, 0)' for n in DIMENSIONS)} FROM s WHERE vec_id % 6 IN (0, 2)""")
def judge_totals(spark, d):
    """Scores from answers of all shapes, written from the embeddings: a list, a map, `scores`, one entry under either name of its id, and text that is no JSON."""
    raw = [F.bround(F.get("embedding", k).cast("double") * 20, 1) for k in range(3)]
    pairs = [F.concat(F.lit(f'"{n}": '), x.cast("string")) for n, x in zip(DIMENSIONS, raw)]
    body = F.concat_ws(", ", *pairs, F.lit('"length": "long"'), F.concat(F.lit('"sensory_cue": '), (F.col("vec_id") % 3).cast("string")))
    named = lambda name, p: F.concat(F.lit(f'{{"{name}": "{p}'), F.col("vec_id").cast("string"), F.lit('", '), body, F.lit("}"))
    two = F.concat(F.lit("["), named("id", "a"), F.lit(', 7, null, {"length": 1}, '), named("anon_id", "b"), F.lit("]"))
    shapes = [two, F.concat(F.lit('{"m'), F.col("vec_id").cast("string"), F.lit('": {'), body, F.lit("}}")), F.concat(F.lit('{"scores": '), two, F.lit("}")), named("id", "a"), named("ID", "a"), F.lit("I would say {2}")]
    answer = F.coalesce(*[F.when(F.col("vec_id") % 6 == k, x) for k, x in enumerate(shapes)])
    return judge_scores(ad.table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), answer.alias("answer")))
