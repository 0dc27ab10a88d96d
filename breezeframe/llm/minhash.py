"""Near-duplicate documents: MinHash signatures joined through an inverted index of their coordinates.

1. Each text becomes its set of distinct word shingles and a MinHash signature of K
   coordinates. Texts with equal sets form a class; only classes go on.
2. A class is posted under each (coordinate, value) pair. Pairs that one class alone
   holds join nothing; a class with fewer than MATCHES shared pairs has no partner.
3. A class orders its pairs by the length of their lists. Two classes that agree in
   MATCHES coordinates share a pair among the first (shared - MATCHES + 1) of either
   one, its prefix; the longer lists are skipped and only looked up, in the
   signatures of the candidates.
4. Every list has a hub, the member whose lists are longest in sum. Members are
   compared with their hubs first; this ties large groups of copies together in as
   many comparisons as they have members.
5. Short lists then give the pairs of their members that are in different components.
   In long lists, the members outside their hub's component are compared with all
   members, in blocks of bounded size that emit a spanning forest, never all pairs.
6. A candidate that agrees in MATCHES coordinates is confirmed on the full sets; the
   components of the confirmed links give each document's component_id.

With K = 64 and MATCHES = 38 a pair of similarity 0.8 is missed with a chance of about
3 in 100,000; pairs above it are missed less often.

Nulls and ties: null and blank texts have no shingles, link with nothing and stay;
a text of fewer words than a shingle is one shingle; rows with a null doc_id are
compared like others, but their component is named by its least id that is not null
(null if it has none, and then they are marked as kept). Rows that repeat a doc_id are
compared like others. A very long text is one set. An empty table gives an empty
result. Other columns are ignored, and keep their values where rows are returned,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_or_shuffled, stored, table

K, MATCHES = 64, 38
#: Similarity as a ratio: links have PER_CENT of 100 or more.
PER_CENT = 80
SHORT_LIST = 32
BLOCK, CHUNK = 200, 2000
#: Words whose hashes a worker keeps.
KEEP_WORDS = 500_000


class _Hashes(dict):
    """Word -> 64-bit hash, computed once for each word that a worker meets."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > KEEP_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str, size: int, hashes: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text, lower-cased in A-Z."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    out = np.full(n, 0x2545F4914F6CDD1D + width, np.uint64)
    for k in range(width):
        out = (out ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def multipliers(k: int = K) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(1)).integers(1, 1 << 62, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, by: np.ndarray) -> np.ndarray:
    out = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(out, (by[:, None] * shingles[None, at : at + 2048]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def set_hashes(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two 64-bit hashes of each set, which together tell sets apart."""
    digests = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
    return [pa.array(x) for x in np.frombuffer(digests, "<i8").reshape(-1, 2).T]


def _list_column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, by = _Hashes(), multipliers()
        for batch in batches:
            sets = [shingle_set(t.as_py() or "", size, hashes) for t in batch.column("text")]
            empty = np.empty(0, np.int32)
            sigs = _list_column([signature(s, by) if len(s) else empty for s in sets], pa.int32())
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([len(s) for s in sets], pa.int64()), *set_hashes(sets), sigs], names=[*rest.schema.names, "n_shingles", "c1", "c2", "sig"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                some = [shingle_set(t.as_py() or "", size, hashes) for t in batch.column(0)[at : at + 1000]]
                yield pa.RecordBatch.from_arrays([*set_hashes(some), _list_column([s.view(np.int64) for s in some], pa.int64())], names=["c1", "c2", "shingles"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for the ends of edges (a, b): equal roots are connected; the root is the component's least id.

    Each round points every root to its least neighbour, follows the pointers to
    their ends by doubling, and contracts the edges; it ends when none is left.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        point = stored(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root")), "pointers")
        while True:
            onward = point.select(F.col("id").alias("root"), F.col("root").alias("_next"))
            longer = point.join(onward, "root")
            if longer.isEmpty():
                break
            point = stored(point.join(onward, "root", "left").select("id", F.coalesce("_next", "root").alias("root")), "pointers")
        if roots is None:
            roots = point
        else:
            moved = roots.join(point.select(F.col("id").alias("root"), F.col("root").alias("_next")), "root", "left").select("id", F.coalesce("_next", "root").alias("root"))
            roots = stored(moved.unionByName(point.join(roots, "id", "left_anti")), "roots")
        to = lambda c: point.select(F.col("id").alias(c), F.col("root").alias(f"_{c}"))
        edges = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if roots is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    # The ends of pointers are roots of their own.
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that agree in MATCHES coordinates and whose full sets are similar enough."""
    side = lambda t, c, v: t.select(F.col("cid").alias(c), F.col(v).alias(f"_{c}"))
    agree = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    near = pairs.join(side(sigs, "a", "sig"), "a").join(side(sigs, "b", "sig"), "b").where(agree >= MATCHES).select("a", "b")
    both = stored(near, "candidates").join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b")
    common = F.size(F.array_intersect("_a", "_b"))
    return both.where(100 * common >= PER_CENT * (F.size("_a") + F.size("_b") - common)).select("a", "b")


def block_links(group: pa.Table) -> pa.Table:
    """Spanning links of one block: its outer members (side 0) against its chunk of all members (side 1)."""
    side, cids, roots = (np.array(group.column(c).to_numpy()) for c in ("side", "cid", "root"))
    sets = group.column("shingles")
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    out: list[tuple[int, int]] = []
    if len(left) and len(right):
        flat = [sets[int(i)].values.to_numpy() for i in left]
        vocabulary = np.unique(np.concatenate(flat))
        size = np.array([len(x) for x in flat])
        rows = np.zeros((len(left), len(vocabulary)), np.float32)
        for k, x in enumerate(flat):
            rows[k, np.searchsorted(vocabulary, x)] = 1
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for at in range(0, len(right), 250):
            some = right[at : at + 250]
            other = [sets[int(j)].values.to_numpy() for j in some]
            columns = np.zeros((len(vocabulary), len(some)), np.float32)
            for k, x in enumerate(other):
                p = np.searchsorted(vocabulary, x)
                p[p == len(vocabulary)] = 0
                columns[p[vocabulary[p] == x], k] = 1
            common = np.rint(rows @ columns).astype(np.int64)
            sizes = size[:, None] + np.array([len(x) for x in other])[None, :] - common
            linked = (100 * common >= PER_CENT * sizes) & (roots[left][:, None] != roots[some][None, :])
            for i, j in zip(*np.nonzero(linked)):
                a, b = find(int(roots[left[i]])), find(int(roots[some[j]]))
                if a != b:
                    up[a] = b
                    out.append((int(cids[left[i]]), int(cids[some[j]])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def _long_list_links(groups: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links found in groups (hub, cid): members outside the hub's component against all members, in blocks."""
    named = groups.join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = named.join(roots.select(F.col("id").alias("hub"), F.col("root").alias("_hub_root")), "hub", "left")
    named = stored(named.select("hub", "cid", "root", (F.col("root") != F.coalesce("_hub_root", "hub")).alias("outer")), "members")
    sizes = named.groupBy("hub").agg(F.count("*").alias("_all"), F.count_if("outer").alias("_outer")).where("_outer > 0")
    sizes = sizes.select("hub", F.ceil(F.col("_outer") / BLOCK).cast("int").alias("_blocks"), F.ceil(F.col("_all") / CHUNK).cast("int").alias("_chunks"))
    named = named.join(sizes, "hub")
    block = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("_blocks")).cast("int")
    chunk = F.pmod(F.xxhash64("cid", F.lit(2)), F.col("_chunks")).cast("int")
    left = named.where("outer").select("hub", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "cid", "root")
    right = named.select("hub", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"), chunk.alias("chunk"), F.lit(1).alias("side"), "cid", "root")
    members = left.unionByName(right).join(sets, "cid")
    return members.groupBy("hub", "block", "chunk").applyInArrow(block_links, "a long, b long")


def linked_classes(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(id, root) for every class (cid, c1, c2, doc_id, sig) that is linked with another one."""
    value = F.col("_v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    key = F.shiftleft(F.col("_k").cast("long"), 32).bitwiseOR(value).alias("key")
    posts = classes.select("cid", F.posexplode("sig").alias("_k", "_v")).select("cid", key)
    shared = posts.join(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    lists = shared.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("lists"), F.sum("n").alias("weight"))
    lists = stored(lists.where(F.size("lists") >= MATCHES), "posting-lists")
    sigs = stored(classes.join(lists.select("cid"), "cid", "left_semi"), "signatures")
    # A class is fetched by the id of one of its rows, which may be null.
    wanted = sigs.select("cid", "c1", "c2")
    ids = small_or_shuffled(sigs.select(F.col("doc_id").alias("_id")).distinct(), 200_000)
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = stored(texts.select("text").mapInArrow(_sets(size), "c1 long, c2 long, shingles array<long>").join(wanted, ["c1", "c2"]).dropDuplicates(["cid"]).select("cid", "shingles"), "shingle-sets")

    every = lists.select("cid", "weight", F.explode("lists.key").alias("key"))
    hubs = every.groupBy("key").agg(F.max(F.struct("weight", "cid")).alias("_h"), F.count("*").alias("members")).where("members > 1").select("key", F.col("_h.cid").alias("hub"), "members")
    hubs = stored(hubs, "hubs")
    stars = every.select("cid", "key").join(hubs, "key").where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct()
    links = stored(confirmed(stars, sigs, sets), "star-links")
    roots = stored(components(links), "star-roots")

    prefix = lists.select("cid", F.explode(F.slice(F.col("lists.key"), F.lit(1), F.size("lists") - MATCHES + 1)).alias("key"))
    prefix = stored(prefix.join(hubs, "key").join(roots.withColumnRenamed("id", "cid"), "cid", "left").select("key", "hub", "members", "cid", F.coalesce("root", "cid").alias("root")), "prefixes")
    short = prefix.where(F.col("members") <= SHORT_LIST)
    one, two = short.select("key", F.col("cid").alias("a"), F.col("root").alias("_ra")), short.select("key", F.col("cid").alias("b"), F.col("root").alias("_rb"))
    pairs = one.join(two, "key").where("a < b AND _ra <> _rb").groupBy("a", "b").agg(F.count("*").alias("collisions")).select("a", "b")
    more = confirmed(pairs, sigs, sets)
    groups = prefix.where(F.col("members") > SHORT_LIST).select("hub", "cid").distinct()
    more = stored(more.unionByName(_long_list_links(groups, roots, sets)), "links")
    return components(links.unionByName(more))


def rows_with_roots(docs: DataFrame, size: int) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, tie, n_shingles, root, least), one row a document.

    root names the component (null for a text without shingles), least is its least id
    that is not null, and tie tells the texts of one id apart.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("tie"), "text")
    signed = stored(keyed.mapInArrow(_signatures(size), "rid long, doc_id long, tie long, n_shingles long, c1 long, c2 long, sig array<int>"), "signed")
    # A class is named by one of its rows, so no two have one name; 128 bits of hash tell sets apart.
    classes = stored(signed.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig")), "classes")
    roots = linked_classes(docs, classes, size)
    classes = classes.select("c1", "c2", "cid", F.col("doc_id").alias("_least")).join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    classes = stored(classes, "class-roots")
    least = classes.groupBy("root").agg(F.min("_least").alias("least"))
    named = classes.select("c1", "c2", "root").join(least, "root")
    bare = signed.where("n_shingles = 0").select("doc_id", "tie", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("least"))
    return signed.where("n_shingles > 0").join(named, ["c1", "c2"]).select("doc_id", "tie", "n_shingles", "root", "least").unionByName(bare)


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id, kept), one row a document."""
    kept = F.coalesce(F.col("doc_id") == F.col("least"), F.col("least").isNull())
    return rows_with_roots(docs, size).select("doc_id", "n_shingles", F.col("least").alias("component_id"), kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """One row of docs for each component, with the columns of docs: that of its least id, nulls last.

    Rows are told apart by id and text: of rows that repeat both one stays, and where one
    text of an id goes, another of the same id stays. Texts without shingles all stay.
    """
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    rows = rows_with_roots(docs, size).where("root IS NOT NULL").select("root", name.alias("name"))
    names = stored(rows.groupBy("root", "name").agg(F.count("*").alias("n")), "row-names")
    first = names.groupBy("root").agg(F.min("name").alias("first"))
    judged = names.join(first, "root").select("name", (F.col("name") != F.col("first")).alias("goes"), "n")
    gone = stored(judged.where("goes OR n > 1"), "rows-gone")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    doc_id = docs["doc_id"].cast("long")
    keyed = docs.select(row, F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.xxhash64(docs["text"]).alias("tie")).alias("name"))
    back = [F.col("row")[c].alias(c) for c in docs.columns]
    stay = keyed.join(small_or_shuffled(gone.select("name"), 200_000), "name", "left_anti").select(*back)
    repeated = keyed.join(small_or_shuffled(gone.where("NOT goes").select("name"), 200_000), "name", "left_semi").dropDuplicates(["name"])
    return stay.unionByName(repeated.select(*back))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4)
