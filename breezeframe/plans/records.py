"""Queries over records: places, sightings, journal, measurements, texts and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import weather as we
from ..sources import adapters as ad
from .hourly import query, rounded
from .sql import with_views

LAT, LON = 12.97, 77.59
_DIST = f"2 * 6371.0 * asin(least(1.0, sqrt(sin(radians(lat - {LAT}) / 2) ** 2 + cos(radians({LAT})) * cos(radians(lat)) * sin(radians(lon - {LON}) / 2) ** 2)))"


def with_distance(spark, d):
    return ad.parks(spark, d).withColumn("km", we.haversine(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon")))


@query(with_views(ad.PARKS_SQL, f"SELECT park_id, name, round(km, 6) AS km FROM (SELECT *, {_DIST} AS km FROM parks) WHERE km <= 15 ORDER BY km, park_id LIMIT 5"))
def nearest_parks(spark, d):
    near = with_distance(spark, d).where("km <= 15").orderBy("km", "park_id").limit(5)
    return near.select("park_id", "name", rounded(F.col("km")).alias("km"))


@query(with_views(ad.PARKS_SQL, f"SELECT park_id, name, shade FROM (SELECT *, {_DIST} AS km FROM parks) ORDER BY shade <> 'high', km, park_id LIMIT 1"))
def shaded_park(spark, d):
    return with_distance(spark, d).orderBy(F.col("shade") != "high", "km", "park_id").limit(1).select("park_id", "name", "shade")


TALLY = f"{ad.OBSERVATIONS_SQL},\nta AS (SELECT taxon, arg_min(name, pos) AS name, count(*)::BIGINT AS n, max(agreements) AS best FROM obs WHERE agreements >= 1 AND taxon > 0 AND name IS NOT NULL GROUP BY taxon),\ntk AS (SELECT * FROM ta WHERE NOT regexp_matches(lower(name), '\\bring\\b'))"


def tally(spark, d):
    o = ad.observations(spark, d).where("agreements >= 1 AND taxon > 0 AND name IS NOT NULL")
    g = o.groupBy("taxon").agg(F.min_by("name", "pos").alias("name"), F.count("*").alias("n"), F.max("agreements").alias("best"))
    return g.where(~F.lower("name").rlike(r"\bring\b"))


@query(with_views(TALLY, "SELECT taxon, name, n, best FROM tk"))
def species_tally(spark, d):
    return tally(spark, d).select("taxon", "name", "n", "best")


@query(with_views(TALLY, "SELECT taxon, name, n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, best DESC, taxon) AS k FROM (SELECT * FROM tk ORDER BY n DESC, best DESC, name, taxon LIMIT 16)) WHERE k = 1 ORDER BY n DESC, best DESC, name, taxon LIMIT 6"))
def diversified_species(spark, d):
    """The first of each name among the 16 most seen, six at most."""
    order = [F.desc("n"), F.desc("best"), F.col("name"), F.col("taxon")]
    pool = tally(spark, d).orderBy(*order).limit(16)
    first = pool.withColumn("k", F.row_number().over(W.partitionBy("name").orderBy(F.desc("n"), F.desc("best"), "taxon"))).where("k = 1")
    return first.orderBy(*order).limit(6).select("taxon", "name", "n")


@query(with_views(ad.JOURNAL_SQL, "SELECT count(*)::BIGINT AS entries, count(CASE WHEN outcome <> 'skipped' THEN 1 END)::BIGINT AS walks, count(CASE WHEN outcome = 'shortened' THEN 1 END)::BIGINT AS shortened, sum(coalesce(minutes, 0))::BIGINT AS minutes, count(CASE WHEN reached = 1 THEN 1 END)::BIGINT AS reached FROM journal"))
def journal_summary(spark, d):
    c = F.col("outcome")
    return ad.journal(spark, d).agg(F.count("*").alias("entries"), F.count_if(c != "skipped").alias("walks"), F.count_if(c == "shortened").alias("shortened"), F.sum(F.coalesce("minutes", F.lit(0))).alias("minutes"), F.count_if(F.col("reached") == 1).alias("reached"))


@query(with_views(ad.JOURNAL_SQL, "SELECT outcome, species, count(*)::BIGINT AS n, CASE WHEN count(*) >= 3 THEN CAST(round_even(100.0 * sum(CASE WHEN reached = 1 THEN 1 ELSE 0 END)::DOUBLE / count(*), 0) AS BIGINT) || '% of ' || count(*) ELSE NULL END AS reached FROM journal GROUP BY outcome, species"))
def journal_lines(spark, d):
    """Percentages are told from three entries on."""
    percent = F.bround(100.0 * F.count_if(F.col("reached") == 1) / F.count("*"), 0).cast("long")
    return ad.journal(spark, d).groupBy("outcome", "species").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.concat(percent.cast("string"), F.lit("% of "), F.count("*").cast("string"))).alias("reached"))


@query(with_views(f"{ad.READINGS_SQL}, one AS (SELECT station, t, parameter, CASE WHEN count(*) > 1 THEN NULL ELSE max(CASE WHEN parameter = 'signup' THEN value * 1000 ELSE value END) END AS v FROM readings GROUP BY ALL)", "SELECT station, t, " + ", ".join(f"round(max(CASE WHEN parameter = '{kind}' THEN v END), 6) AS {k}" for k, kind in ad.GASES.items()) + " FROM one GROUP BY station, t"))
def station_pivot(spark, d):
    """Long measurements to columns; a key that occurs twice is void; one parameter changes its unit."""
    value = F.when(F.col("parameter") == "signup", F.col("value") * 1000).otherwise(F.col("value"))
    one = ad.readings_long(spark, d).groupBy("station", "t", "parameter").agg(F.when(F.count("*") == 1, F.max(value)).alias("v"))
    wide = one.groupBy("station", "t").agg(*[F.max(F.when(F.col("parameter") == kind, F.col("v"))).alias(k) for k, kind in ad.GASES.items()])
    return wide.select("station", "t", *[rounded(F.col(k)).alias(k) for k in ad.GASES])


@query(with_views(ad.READINGS_SQL, "SELECT station, parameter, count(*)::BIGINT AS keys, count(CASE WHEN n > 1 THEN 1 END)::BIGINT AS repeated, count(CASE WHEN vs > 1 THEN 1 END)::BIGINT AS conflicting FROM (SELECT station, t, parameter, count(*) AS n, count(DISTINCT value) AS vs FROM readings GROUP BY ALL) GROUP BY ALL"))
def archive_conflicts(spark, d):
    """Repeated and conflicting keys: equal repeats are harmless, conflicting ones are errors."""
    keys = ad.readings_long(spark, d).groupBy("station", "t", "parameter").agg(F.count("*").alias("n"), F.count_distinct("value").alias("vs"))
    return keys.groupBy("station", "parameter").agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("vs") > 1).alias("conflicting"))


@query("SELECT o_orderkey, substr(sha256('{\"customer\":' || o_custkey || ',\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}'), 1, 16) AS cache_key FROM orders")
def cache_keys(spark, d):
    """Content keys: canonical JSON with sorted names, then a digest's first 16 digits."""
    doc = F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")))
    return ad.table(spark, d, "orders").select("o_orderkey", F.substring(F.sha2(doc.cast("binary"), 256), 1, 16).alias("cache_key"))


@query("SELECT count(*)::BIGINT AS shared FROM (SELECT text FROM benchmark INTERSECT SELECT text FROM documents)")
def leakage_intersect(spark, d):
    shared = ad.table(spark, d, "benchmark").select("text").intersect(ad.table(spark, d, "documents").select("text"))
    return shared.agg(F.count("*").alias("shared"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def lost_keys_except(spark, d):
    return ad.table(spark, d, "customer").select("c_custkey").subtract(ad.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT CAST(event_type AS VARCHAR) AS kind, user_id FROM (SELECT event_type, user_id FROM events UNION ALL SELECT event_type, user_id FROM events WHERE user_id % 2 = 0) GROUP BY ALL HAVING count(*) > 1")
def union_repeats(spark, d):
    e = ad.table(spark, d, "events").select(F.col("event_type").alias("kind"), "user_id")
    return e.unionByName(e.where("user_id % 2 = 0")).groupBy("kind", "user_id").agg(F.count("*").alias("n")).where("n > 1").select("kind", "user_id")


@query("SELECT count(*)::BIGINT AS missing FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def label_coverage(spark, d):
    lost = ad.table(spark, d, "labels").join(ad.table(spark, d, "documents"), "doc_id", "left_anti")
    return lost.select("doc_id").distinct().agg(F.count("*").alias("missing"))


# Both engines' regular expressions agree on these classes, which are spelled out in ASCII.
_WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
_JOINED = "CASE WHEN text IS NOT NULL THEN coalesce(array_to_string({}, ' '), '') END"


@query(f"SELECT doc_id, CASE WHEN len(w) <= 40 THEN {_JOINED.format('w')} WHEN regexp_extract(h, '^(.*[.!?])', 1) <> '' THEN regexp_extract(h, '^(.*[.!?])', 1) ELSE h || '...' END AS short FROM (SELECT doc_id, text, w, {_JOINED.format('w[1:40]')} AS h FROM (SELECT doc_id, text, {_WORDS} AS w FROM documents))", also="trimmed_texts_all")
def trimmed_texts(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", tx.trim_words(F.col("text"), 40).alias("short"))


_SENTENCES = r"string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1))"


@query(f"""WITH s AS (SELECT doc_id, text, {_WORDS} AS w, {_SENTENCES} AS ss FROM documents),
p AS (SELECT doc_id, k, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM (SELECT doc_id, k, len({_WORDS}) AS n FROM (SELECT doc_id, unnest(ss) AS text, generate_subscripts(ss, 1) AS k FROM s))),
c AS (SELECT doc_id, count(CASE WHEN upto <= 112 THEN 1 END) AS kept FROM p GROUP BY doc_id),
h AS (SELECT s.*, kept, array_to_string(w[1:112], ' ') AS h FROM s LEFT JOIN c USING (doc_id))
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len(w) <= 112 THEN text WHEN kept > 0 THEN trim(array_to_string(ss[1:kept], ' '))
  WHEN regexp_extract(h, '^(.*[.!?])', 1) <> '' THEN regexp_extract(h, '^(.*[.!?])', 1) ELSE h || '...' END AS kept_text FROM h""")
def whole_sentences(spark, d):
    """Each text's first whole sentences of 112 words together."""
    return ad.table(spark, d, "documents").select("doc_id", tx.whole_sentences(F.col("text"), 112).alias("kept_text"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 < 2 AND trim(text) <> '' THEN trim(text) END AS answer,
  CASE WHEN turn % 4 < 2 AND trim(text) <> '' THEN CASE turn % 4 WHEN 0 THEN 'STOP' ELSE 'UNKNOWN' END END AS finish,
  CASE WHEN turn % 4 = 3 THEN 'no candidates' WHEN turn % 4 = 2 THEN 'a thought alone' WHEN trim(text) <> '' THEN NULL ELSE 'a thought alone' END AS error FROM conversations WHERE text IS NOT NULL""")
def answer_texts(spark, d):
    """Turns as a model's responses: a thought and the answer, with and without a finish, a thought alone, and no candidate."""
    kind = F.col("turn") % 4
    thought = F.struct(F.lit("let me see").alias("text"), F.lit(True).alias("thought"))
    said = F.struct(F.concat(F.lit(" "), "text").alias("text"), F.lit(None).cast("boolean").alias("thought"))
    parts = F.when(kind < 2, F.array(thought, said)).otherwise(F.array(thought))
    candidate = F.struct(F.struct(parts.alias("parts")).alias("content"), F.when(kind == 0, "STOP").alias("finishReason"))
    response = F.when(kind < 3, F.to_json(F.struct(F.array(candidate).alias("candidates")))).otherwise(F.lit('{"candidates": []}'))
    rows = ad.table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", tx.answer_parts(response).alias("a"))
    return rows.select("conv_id", "turn", F.col("a.text").alias("answer"), "a.finish", "a.error")


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '(?i)[^.!?]* (?:the|les|der) [^.!?]*[.!?]', '', 'g'), '\s+', ' ', 'g')) AS kept FROM conversations")
def dropped_sentences(spark, d):
    return ad.table(spark, d, "conversations").select("conv_id", "turn", tx.drop_sentences(F.col("text"), ("the", "les", "der")).alias("kept"))


_CODES = rf"""SELECT doc_id, list_filter([CASE WHEN n < 35 THEN 'too_short' END, CASE WHEN n > 80 THEN 'too_long' END, CASE WHEN regexp_matches(lower(text), '(^|[^0-9A-Za-z_])({"|".join(tx.HEDGES)})($|[^0-9A-Za-z_])') THEN 'hedging' END, CASE WHEN contains(text, '!!') THEN 'shouting' END,
  CASE WHEN len(list_filter(regexp_extract_all(text, '(?:^|[^0-9A-Za-z_.])([0-9]+(?:\.[0-9]+)?)', 1), lambda x: TRY_CAST(x AS DOUBLE) > 500)) > 0 THEN 'number_out_of_range' END], lambda x: x IS NOT NULL) AS codes
FROM (SELECT doc_id, text, len({_WORDS}) AS n FROM documents)"""


@query(f"SELECT doc_id, coalesce(array_to_string(codes, ','), '') AS codes FROM ({_CODES})", also="text_defects_all")
def text_defects(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", F.array_join(tx.defects(F.col("text")), ",").alias("codes"))


@query(f"SELECT code, count(*)::BIGINT AS n FROM (SELECT unnest(codes) AS code FROM ({_CODES})) GROUP BY code", also="defect_counts_all")
def defect_counts(spark, d):
    return ad.table(spark, d, "documents").select(F.explode(tx.defects(F.col("text"))).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '^[aeiou]') THEN 'an ' ELSE 'a ' END || p_name AS named, CASE WHEN p_size >= 100 THEN 'many' WHEN p_size >= 20 THEN 'several' WHEN p_size >= 2 THEN 'a few' ELSE 'one' END AS amount FROM part")
def named_counts(spark, d):
    return ad.table(spark, d, "part").select("p_partkey", tx.article(F.col("p_name")).alias("named"), tx.vague_count(F.col("p_size")).alias("amount"))


@query("SELECT o_orderkey, CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 'urgent' WHEN '2-high' THEN 'high' WHEN '3-medium' THEN 'medium' ELSE NULL END AS alias, strftime(o_orderdate, '%H:%M') AS clock, day(o_orderdate) || ' ' || strftime(o_orderdate, '%b %Y') AS spoken, hour(o_orderdate) >= 6 AND hour(o_orderdate) < 19 AS daylight FROM orders")
def canonical_names_dates(spark, d):
    o = ad.table(spark, d, "orders")
    known = F.create_map(*map(F.lit, ("1-urgent", "urgent", "2-high", "high", "3-medium", "medium")))
    t = F.col("o_orderdate")
    return o.select("o_orderkey", F.try_element_at(known, F.lower(F.trim("o_orderpriority"))).alias("alias"), F.date_format(t, "HH:mm").alias("clock"), F.date_format(t, "d MMM yyyy").alias("spoken"), ((F.hour(t) >= 6) & (F.hour(t) < 19)).alias("daylight"))


@query("SELECT vec_id, list_position(p, list_max(p)) - 1 AS top, round(list_max(p), 5) AS best FROM (SELECT vec_id, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS p FROM embeddings)", also="argmax_vector_all")
def argmax_vector(spark, d):
    p = F.transform("embedding", lambda x: F.abs(x).cast("double"))
    return ad.table(spark, d, "embeddings").withColumn("p", p).select("vec_id", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("top"), rounded(F.array_max("p"), 5).alias("best"))


@query("SELECT r_name, count(*)::BIGINT AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def dimension_lookup(spark, d):
    """Fixed dimensions are broadcast; they have 25 and 5 rows by definition."""
    dims = ad.table(spark, d, "nation").join(F.broadcast(ad.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = ad.table(spark, d, "customer")
    return c.join(F.broadcast(dims), c["c_nationkey"] == dims["n_nationkey"]).groupBy("r_name").agg(F.count("*").alias("customers"), rounded(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT conv_id, count(*)::BIGINT AS turns, count(CASE WHEN role = 'assistant' THEN 1 END)::BIGINT AS answers, count(CASE WHEN prev = role THEN 1 END)::BIGINT AS same_role_twice, max(turn) - min(turn) + 1 = count(*) AS gapless FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY conv_id")
def conversation_preflight(spark, d):
    c = ad.table(spark, d, "conversations").withColumn("prev", F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.count_if(F.col("prev") == F.col("role")).alias("same_role_twice"), ((F.max("turn") - F.min("turn") + 1) == F.count("*")).alias("gapless"))
