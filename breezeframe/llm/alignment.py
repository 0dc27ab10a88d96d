"""Alignment of two tokenizers over the same text, as joins and windows of token rows.

Tokenizer A (byte-level BPE) and tokenizer B (pieces with byte fallback) encode a space and the text. Where
tokens of both end at the same byte, the text is cut into groups; a link is a pair of an A and a B token whose
bytes overlap.

1. Texts are cut into segments at places where, whatever stands around them, both tokenizers end a
   token: before a space that stands between letters or follows `.`, `,` or a line end, and
   between a letter and one of these. The tokens of a text are those of its segments in order.
   Texts keep the numbers of their segments in a dictionary of their block (some `BLOCK_BYTES` of text).
2. The distinct segments of the corpus are encoded once, and their tokens become rows: `posexplode`, a windowed sum of
   byte lengths for the ends, A's and B's rows matched on (segment, end) for the cuts (a full equi-join, done as a
   grouping, so that one dealing by segment serves every step), and the running count of cuts as group number. The range join of overlapping tokens is done over the joined ends in order: the stretch
   between two neighbouring ends lies in one A and one B token, and is their only overlap. That takes linear work
   where a join on the group would compare all pairs in it.
3. A pair of ids counts once for each link, times the occurrences of its segment. B's ids are at most its
   vocabulary, so their highest counts are a table of bounded size, which is broadcast.
4. Sums and groups of segments go back to the blocks that have them, and each text adds up its segments.

A segment is a text's unit here as the document would be: a text in which nothing can be cut is one segment, and no row
of tokens is made twice for words that recur.

The token bytes of a text may differ from the text (U+2581 reads as a space, other models may normalise). Such texts have
no tokens; if there are any, occurrences in them are taken off before counting.

Nulls and ties: null and empty texts have zeros and an empty digest; a null doc_id is kept; repeated rows
are texts of their own and count each time; ids that tie for the highest count are all best. A very long text is a block
of its own. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, local_threads, stored, table
from .packing import slices

#: Letters of ASCII and Latin-1. Neither vocabulary has an entry that crosses a cut between them and the marks below.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
SEPARATOR = "\x00"
#: Not every possible cut must be made, so one pass over each rule will do. A line end after white space is left to its letter,
#: for A's rule for white space looks at what follows.
RULES = [rf"([{LETTER}.,]\n)([{LETTER}])", rf"([.,])([{LETTER}])", rf"([{LETTER}])([.,\n])", rf"([{LETTER}.,\n])( [{LETTER}])"]
BLOCK_BYTES = 8 << 20
#: Blocks are dealt out with their segments in so many slices.
SLICES = 2
#: Segments that reach the tokenizers together.
ENCODE = 2000
BLOCKS = "block long, doc_id long, numbers binary, number int, segment string, n long"
TOKENS = "segment string, n long, fits boolean, first_b int, ids array<int>, lengths array<int>"
DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- segments


def segmented(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(numbers of the segments of all texts, distinct segments, segments of each text) of texts without nulls; an empty one has none."""
    texts = pc.cast(texts, pa.large_string())
    spaced = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))
    cut = spaced
    for rule in RULES:
        cut = pc.replace_substring_regex(cut, rule, rf"\1{SEPARATOR}\2")
    # A text that has the separator itself stays whole.
    whole = pc.match_substring(spaced, SEPARATOR)
    parts = pc.split_pattern(pc.if_else(whole, pa.scalar("", texts.type), cut), SEPARATOR)
    del cut
    found = parts.flatten().to_pylist() if pc.any(whole).as_py() else None
    if found is not None:
        found, at = [], parts.to_pylist()
        for k, keep in enumerate(whole.to_pylist()):
            at[k] = [spaced[k].as_py()] if keep else at[k]
            found += at[k]
        counts, flat = np.array([len(x) for x in at], np.int64), pa.array(found, pa.large_string())
    else:
        counts, flat = pc.list_value_length(parts).to_numpy().astype(np.int64), parts.flatten()
    none = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    if none.any():
        flat = flat.filter(pa.array(~np.repeat(none, counts)))
        counts[none] = 0
    numbered = flat.dictionary_encode()
    return numbered.indices.to_numpy().astype(np.int64), numbered.dictionary, counts


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, all low ones first: the high ones are mostly zero and take no room once compressed."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> a row for each text with its segments' numbers, and one for each distinct segment of a block with its number and occurrences."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.int64()]
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        texts = batch.column(1)
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        for lo, hi in slices(texts, BLOCK_BYTES):
            pa.default_memory_pool().release_unused()
            numbers, segments, counts = segmented(texts[lo:hi])
            times = np.bincount(numbers, minlength=len(segments))
            # Frequent segments get small numbers, which compress well.
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            own, n, m = np.split(rank[numbers], np.cumsum(counts)[:-1]), hi - lo, len(order)
            docs = pa.array([packed(x) for x in own], types[2])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), batch.column(0)[lo:hi], docs, *[pa.nulls(n, t) for t in types[3:]]], names=names)
            rows = pa.Table.from_arrays([pa.array(np.full(m, block)), pa.nulls(m, types[1]), pa.nulls(m, types[2]), pa.array(np.arange(m, dtype=np.int32)), pc.cast(segments.take(pa.array(order)), types[4]), pa.array(times[order])], names=names)
            yield from rows.to_batches(100_000)
            block += 1
            del numbers, segments, counts, own, rank, rows, docs


class Tokens:
    """Both tokenizers, for segments."""

    def __init__(self, path_a: str, path_b: str):
        local_threads()
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        # The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in set(printable)]
        byte_of = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(others)}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in vocabulary.items()}
        self.bytes_b = {i: self.piece_bytes(i) for i in range(self.b.get_piece_size())}
        self.length_a, self.length_b = ({i: len(x) for i, x in of.items()} for of in (self.bytes_a, self.bytes_b))
        rule = json.loads(self.a.pre_tokenizer.__getstate__())
        crossing = [t for t in map(self.b.id_to_piece, self.bytes_b) if any(re.search(p, t.replace("▁", " ")) for p in RULES) or "\n" in t]
        if rule.get("type") != "ByteLevel" or not rule.get("use_regex") or crossing:
            raise ValueError(f"texts can't be cut into segments for these tokenizers: {crossing[:5] or rule}")

    def piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of segments, each as it stands within a text."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        # B puts a space first. A segment that has none follows a line end here, whose own tokens (the space and the byte) then go.
        ids_b = self.b.encode([s[1:] if s.startswith(" ") else "\n" + s for s in segments], num_threads=1)
        return ids_a, [ids if s.startswith(" ") else ids[2:] for s, ids in zip(segments, ids_b)]


def _tokens(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tokens(path_a, path_b)

        def lists(flat: list[list[int]]) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)), pa.array([i for x in flat for i in x], pa.int32()))

        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE):
                some = batch.slice(at, ENCODE)
                segments = some.column(0).to_pylist()
                ids_a, ids_b = own.encode(segments)
                fits = [(raw := s.encode()) == b"".join(map(own.bytes_a.__getitem__, x)) and raw == b"".join(map(own.bytes_b.__getitem__, y)) for s, x, y in zip(segments, ids_a, ids_b)]
                lengths = [[*map(own.length_a.__getitem__, x), *map(own.length_b.__getitem__, y)] for x, y in zip(ids_a, ids_b)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(fits, pa.bool_()), pa.array([len(x) for x in ids_a], pa.int32()), lists([x + y for x, y in zip(ids_a, ids_b)]), lists(lengths)], names=[x.split()[0] for x in TOKENS.split(", ")])

    return run


# --- rows of tokens


def token_ends(tokens: DataFrame) -> DataFrame:
    """tokens (sid, first_b, ids, lengths), A's before B's -> (sid, side, id, end): a row for each token of either side (true: B) with the byte after it."""
    # Dealt out before the tokens become rows; all that follows is by segment too.
    rows = tokens.repartition("sid").select("sid", "first_b", F.posexplode(F.arrays_zip("ids", "lengths")).alias("pos", "t"))
    rows = rows.select("sid", "pos", (F.col("pos") >= F.col("first_b")).alias("side"), F.col("t.ids").alias("id"), F.col("t.lengths").alias("length"))
    return rows.select("sid", "side", "id", F.sum("length").over(Window.partitionBy("sid", "side").orderBy("pos")).alias("end"))


def stretches(tokens: DataFrame) -> DataFrame:
    """(sid, end, a_id, b_id, grp, a_of, b_of): the ends of either side's tokens; a_id and b_id are those that end there.

    grp counts the cuts from there on. The stretch before an end lies in one A and one B token, a_of and b_of: the
    first of each to end there or later. Overlaps of two tokens have no end within, so stretches are the links.
    """
    ids = [F.max(F.when(F.col("side") == (s == "b"), F.col("id"))).alias(f"{s}_id") for s in ("a", "b")]
    both = token_ends(tokens).groupBy("sid", "end").agg(*ids)
    back = Window.partitionBy("sid").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (F.col("a_id").isNotNull() & F.col("b_id").isNotNull()).cast("int")
    return both.select("*", F.sum(cut).over(back).cast("int").alias("grp"), *[F.last(f"{s}_id", True).over(back).alias(f"{s}_of") for s in ("a", "b")])


def pair_of(a_id: Column, b_id: Column) -> Column:
    """A pair of ids as one number, A's above the low 32 bits."""
    return F.shiftleft(a_id.cast("long"), 32).bitwiseOR(b_id.cast("long"))


def aligned(tokens: DataFrame) -> DataFrame:
    """tokens -> (sid, n_a, n_b, n_groups, n_links, groups, links): groups as `a1,a2|b1;...`, links as an array of pairs, see `pair_of`."""
    inner = F.sort_array(F.collect_list(F.struct("end", "a_id", "b_id", "a_of", "b_of")))
    rows = stretches(tokens).groupBy("sid").agg(inner.alias("_in"), F.count("a_id").alias("n_a"), F.count("b_id").alias("n_b"), F.max("grp").cast("long").alias("n_groups"))
    ends = lambda x: x["a_id"].isNotNull() & x["b_id"].isNotNull()
    rows = rows.withColumn("_cuts", F.filter(F.sequence(F.lit(1), F.size("_in")), lambda k: ends(F.get("_in", k - 1))))
    ids = lambda own, c: F.array_join(F.transform(F.filter(own, lambda x: x[c].isNotNull()), lambda x: x[c].cast("string")), ",")

    def text(cut, k):
        """A group: what stands between two cuts."""
        last = F.when(k == 0, F.lit(0)).otherwise(F.get("_cuts", k - 1))
        own = F.slice("_in", last + 1, cut - last)
        return F.concat_ws("|", ids(own, "a_id"), ids(own, "b_id"))

    groups = F.array_join(F.transform("_cuts", text), ";")
    links = F.transform("_in", lambda x: pair_of(x["a_of"], x["b_of"]))
    return rows.select("sid", "n_a", "n_b", "n_groups", F.size("_in").cast("long").alias("n_links"), groups.alias("groups"), links.alias("links"))


# --- counts


def pair_counts(rows: DataFrame, times: DataFrame) -> DataFrame:
    """(pair, count, best) of rows (sid, links) and times (sid, n): how many links hold each pair; best: no pair of its B id has more."""
    links = rows.select("sid", "links").join(times, "sid").select("n", F.explode("links").alias("pair"))
    counts = stored(links.groupBy("pair").agg(F.sum("n").alias("count")), "alignment-counts")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id")
    highest = counts.groupBy(b_id).agg(F.max("count").alias("_most"))
    # A row for each id of B's vocabulary at most.
    out = counts.select("*", b_id).join(F.broadcast(highest), "b_id").select("pair", "count", (F.col("count") == F.col("_most")).cast("int").alias("best"))
    out = stored(out, "alignment-pairs")
    discard(counts)
    return out


def _spoiled(docs: pa.Table, bad: pa.Table) -> pa.Table:
    """The occurrences of a block's segments in texts that have one of the bad ones."""
    wrong, lost = np.array(bad.column("number").to_pylist(), np.int64), []
    for raw in docs.column("numbers").to_pylist():
        own = unpacked(raw)
        if np.isin(own, wrong).any():
            lost.append(own)
    number, n = np.unique(np.concatenate([np.empty(0, np.int64), *lost]), return_counts=True)
    block = docs.column("block")[0].as_py() if docs.num_rows else 0
    return pa.table({"block": pa.array([block] * len(number), pa.int64()), "number": pa.array(number.astype(np.int32)), "lost": pa.array(n.astype(np.int64))})


def sound_times(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """(sid, n): the occurrences of segments in texts all of whose segments fit."""
    bad = segments.where("NOT fits").select("segment")
    times = segments.select("sid", "n")
    if bad.isEmpty():
        return times
    words = blocks.where("number IS NOT NULL").select("block", "number", "segment")
    wrong = stored(words.join(bad, "segment", "left_semi").select("block", "number"), "alignment-bad")
    docs = blocks.where("numbers IS NOT NULL").select("block", "numbers").join(wrong.select("block").distinct(), "block", "left_semi")
    lost = docs.groupBy("block").cogroup(wrong.groupBy("block")).applyInArrow(_spoiled, "block long, number int, lost long")
    taken = lost.join(words, ["block", "number"]).groupBy("segment").agg(F.sum("lost").alias("lost"))
    return segments.join(taken, "segment", "left").select("sid", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n"))


# --- texts


def _digested(docs: pa.Table, rows: pa.Table) -> pa.Table:
    """DIGESTS of a block's texts from those of its segments."""
    order = np.argsort(rows.column("number").to_numpy())
    sums = [rows.column(c).to_numpy().astype(np.int64)[order] for c in SUMS]
    fits = rows.column("fits").to_numpy(zero_copy_only=False).astype(bool)[order]
    groups = [x.encode() for x in rows.column("groups").take(pa.array(order)).to_pylist()]
    out = []
    for doc_id, raw in zip(docs.column("doc_id").to_pylist(), docs.column("numbers").to_pylist()):
        own = unpacked(raw)
        if len(own) and fits[own].all():
            text = b";".join([groups[k] for k in own.tolist()])
            out.append((doc_id, *[int(x[own].sum()) for x in sums], hashlib.sha256(text).hexdigest()))
        else:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()]
    return pa.Table.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), types)] if out else [pa.nulls(0, t) for t in types], names=names)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (blocks, rows), stored tables.

    blocks: the texts as numbers of segments, and the segments of each block by number. rows, for each segment: fits,
    n_a, n_b, n_groups, groups, n_links, n_best, count_sum.
    """
    own = tokenizer_paths()
    blocks = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_segments, BLOCKS), "alignment-blocks")
    distinct = blocks.where("number IS NOT NULL").groupBy("segment").agg(F.sum("n").alias("n"))
    tokens = distinct.mapInArrow(_tokens(path_a or own[0], path_b or own[1]), TOKENS)
    segments = stored(tokens.withColumn("sid", F.monotonically_increasing_id()), "alignment-segments")
    found = stored(aligned(segments.where("fits").select("sid", "first_b", "ids", "lengths")), "alignment-found")
    pairs = pair_counts(found, sound_times(blocks, segments))
    linked = found.select("sid", F.explode("links").alias("pair")).join(pairs, "pair").groupBy("sid").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    linked = stored(linked, "alignment-linked")
    discard(pairs)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in SUMS]
    rows = segments.select("sid", "segment", "fits").join(found.drop("links"), "sid", "left").join(linked, "sid", "left")
    rows = stored(rows.select("segment", "fits", *zero, F.coalesce("groups", F.lit("")).alias("groups")), "alignment-rows")
    for part in (segments, found, linked):
        discard(part)
    return blocks, rows


def document_digests(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """DIGESTS of docs (doc_id, text), one row a text, as stored tables; blocks are worked through in SLICES by hash, so that only a slice is dealt out at once."""
    blocks, rows = align(docs, path_a, path_b)
    out = []
    for k in range(SLICES):
        own = blocks.where(F.pmod(F.xxhash64("block"), F.lit(SLICES)) == k)
        texts = own.where("numbers IS NOT NULL").select("block", "doc_id", "numbers")
        parts = own.where("number IS NOT NULL").select("block", "number", "segment").join(rows, "segment").drop("segment")
        out.append(stored(texts.groupBy("block").cogroup(parts.toDF(*parts.columns).groupBy("block")).applyInArrow(_digested, DIGESTS), "alignment-digests"))
    for part in (blocks, rows):
        discard(part)
    return reduce(DataFrame.unionByName, out)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_digests(table(spark, sf_dir, "documents"))
