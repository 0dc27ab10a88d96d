"""Packing by power-of-two decomposition.

A document's token ids are cut into pieces whose lengths are the powers of two of
its length's binary form (the largest repeats while the rest is longer), the
largest first. Every piece is a sequence of its own, so no sequence crosses
documents and none needs padding; pieces of one length form one bucket and are
batched together.

The tokenizer drops white space and never merges across it, so a text's ids are its
words' ids in order, and a plain word's ids are those of the parts that the
tokenizer cuts it into. Arrow numbers the distinct words of a few megabytes of text
at a time; only their distinct parts reach a table, and only parts that the table
lacks reach the tokenizer, thousands in one call. The table has a bounded number of
parts and lives as long as its task.

Nulls and ties: a null or empty text has the end id alone, one piece of length 1;
a null doc_id and repeated rows are packed like any other row, each piece with a
sequence_id of its own; extra columns are ignored, whatever their names; an empty
table gives an empty result. A very long text is one slice of its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_threads, table

MAX_LENGTH = 4096
END_ID = 2
#: Bytes that a task's table may hold before it starts anew, at some PART_BYTES for each part besides its characters.
TABLE_BYTES, PART_BYTES = 48 << 20, 200
#: Parts that reach the tokenizer together.
LEARN = 2000
#: Bytes of text that are encoded together.
SLICE_BYTES = 4 << 20
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Any character but those for which joining with spaces changes nothing that the tokenizer sees: printable ASCII and Latin letters.
ODD = r"[^!-~À-ÖØ-öø-įı-ſ]"
#: The tokenizer's own rule for cutting words, on lower-cased plain ones, and the line end that parts words here.
CUT = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-zß-öø-ſ0-9]+")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def spread(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches flat[start : start + length], end to end."""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


class PartTable(dict):
    """Part of a word -> its number in `starts` and `lengths`, which point into `flat`; missing parts are numbered and noted in `new`."""

    def __init__(self, path: str):
        local_threads()
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        # Parts are lower-cased and cut already, so white space alone parts them.
        self.of_part = Tokenizer(self.tok.model)
        self.of_part.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.held, self.new = 0, []
        # The line end that parts words has no ids.
        self.flat, self.lengths = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self["\n"] = 0

    def __missing__(self, part: str) -> int:
        at = self[part] = len(self)
        self.held += PART_BYTES + len(part)
        self.new.append(part)
        return at

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, end to end, and their numbers."""
        found = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def learn(self) -> None:
        """Look the noted parts up."""
        flat, lengths = [self.flat], [self.lengths]
        for at in range(0, len(self.new), LEARN):
            some = self.new[at : at + LEARN]
            ids = np.array(self.of_part.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids]) + 1
            n = np.diff(last, prepend=0)
            if len(last) != len(some):  # there is a part that the tokenizer cuts in another way
                ids, n = self.each(some)
            flat.append(ids)
            lengths.append(n)
        self.new.clear()
        self.flat, self.lengths = np.concatenate(flat), np.concatenate(lengths)

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, end to end, and their numbers."""
        if self.held > TABLE_BYTES:
            self.reset()
        odd = pc.match_substring_regex(words, ODD).to_numpy(zero_copy_only=False)
        plain = pc.utf8_lower(words.filter(pa.array(~odd)))
        lines = pc.binary_join(pa.LargeListArray.from_arrays([0, len(plain)], plain), "\n")[0].as_py() if len(plain) else ""
        parts = CUT.findall(lines)
        at = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        self.learn()
        n = self.lengths[at]
        flat = spread(self.flat, (np.cumsum(self.lengths) - self.lengths)[at], n)
        lengths = np.diff(np.append(np.cumsum(n)[at == 0], n.sum()), prepend=0)[: len(plain)]
        if not odd.any():
            return flat, lengths
        more, n = self.each(words.filter(pa.array(odd)).to_pylist())
        every = np.empty(len(odd), np.int64)
        every[~odd], every[odd] = lengths, n
        starts = np.empty(len(odd), np.int64)
        starts[~odd], starts[odd] = np.cumsum(lengths) - lengths, len(flat) + np.cumsum(n) - n
        return spread(np.concatenate([flat, more]), starts, every), every

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (no nulls), end to end, and their numbers: as the tokenizer gives them for each whole text."""
        marked = np.zeros(len(texts), bool)
        for s in SPECIAL:
            marked |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if marked.any():  # these can hold ids that reach across white space
            found = [self.each([t.as_py()]) if m else self.encode(texts[k : k + 1]) for k, (t, m) in enumerate(zip(texts, marked))]
            return np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids, n = self.of_words(words.dictionary)
        starts, at = np.cumsum(n) - n, words.indices.to_numpy()
        ends = np.cumsum(np.concatenate([[0], n[at]]))
        places = np.cumsum(np.concatenate([[0], pc.list_value_length(split).to_numpy()]))
        return spread(ids, starts[at], n[at]), np.diff(ends[places])


def binary_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Powers of two of at most `longest`, itself one, that sum to n, in descending order."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n % longest >> k & 1]


def cut_documents(ids: np.ndarray, counts: np.ndarray, longest: int) -> tuple[np.ndarray, ...]:
    """(document, start, length, crc32, doc_tokens, piece) of the pieces of documents with so many of ids, the end id added to each."""
    tokens = counts + 1
    ends = np.cumsum(tokens)
    whole = np.empty(int(ends[-1]), "<u4")
    inner = np.ones(len(whole), bool)
    inner[ends - 1] = False
    whole[inner], whole[ends - 1] = ids, END_ID
    powers = np.arange(longest.bit_length() - 2, -1, -1)
    times = np.column_stack([tokens // longest, tokens[:, None] % longest >> powers & 1])
    length = np.repeat(np.tile(np.concatenate([[longest], 1 << powers]), len(tokens)), times.ravel())
    pieces = times.sum(axis=1)
    document = np.repeat(np.arange(len(tokens)), pieces)
    begin = np.cumsum(length) - length
    raw = memoryview(whole).cast("B")
    crc = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())], np.int64)
    piece = np.arange(len(length)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return document, begin - (ends - tokens)[document], length, crc, tokens[document], piece


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold some `most` bytes of text, each at least one row."""
    sizes, first, held = pc.binary_length(texts).to_pylist(), 0, 0
    for k, n in enumerate(sizes):
        if k > first and held + n > most:
            yield first, k
            first, held = k, 0
        held += n
    if sizes:
        yield first, len(sizes)


def _pieces(path: str, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = PartTable(path)
        for batch in batches:
            doc_ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            for a, b in slices(texts):
                document, *rest = cut_documents(*parts.encode(texts[a:b]), longest)
                yield pa.RecordBatch.from_arrays([doc_ids[a:b].take(pa.array(document)), *[pa.array(x, pa.int64()) for x in rest]], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = MAX_LENGTH) -> DataFrame:
    """docs (doc_id, text) -> one row a piece, which is a whole sequence of the bucket of its length.

    sequence_id numbers the pieces; bucket is the exponent of the piece's length.
    Nothing is shuffled: a writer batches by partitioning on `bucket`.
    """
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer or tokenizer_path(), longest), PIECES)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.log2("length").cast("int"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")
