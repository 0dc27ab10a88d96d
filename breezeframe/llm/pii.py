"""Personal data: base patterns, and bootstrapped extraction of identifiers they do not know.

1. Base spans: e-mail, IP address, card and telephone numbers, by fixed patterns.
2. Candidates: base spans; tokens that look like identifiers (five digits or more, or a
   mix of letters and three digits or more); and whatever stands as the value of a key
   (`token = "..."`, `user: ...`), digits or not. Seeds are the base spans, with weight 1,
   and tokens of a shape that words do not have (long hexadecimal or mixed strings), with
   less. Every candidate has lexical patterns: its key, or else the word before, the two
   words before, the word after, and the words on both sides.
3. Patterns and instances form a graph. A pattern's confidence is the weight of its
   instances over all mentions of its words in the corpus, whatever follows them, so
   frequent words prove nothing; a key's mentions are all its values. An instance's weight
   is the noisy-or of its own and of the patterns that it stands in. Rounds over the graph
   let new instances support new patterns, until no pattern is new; confidences only rise.
4. Patterns of high confidence that several different instances support add the
   candidates in them as spans of kind `id`; base spans stay as they are.

The words of patterns are counted over the whole corpus. A bit map of fixed size keeps
most other words from being shuffled; what it lets through a join drops.

Nulls and ties: a null text is empty and has no spans; a null doc_id is kept; repeated
rows have equal results. Words and keys of over 64 characters are no context. A very long text is
read in linear time. An empty table gives an empty result. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_or_shuffled, stored, table

KINDS = ("email", "ip", "card", "phone", "id")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that starts within a run of digits would also start at its beginning.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\s]*")
KEY = re.compile(r"^(.*[=:])(?=[^=:])")
#: What follows a key: = or :, and the value up to white space or, in quotes, to the closing one.
VALUE = re.compile(r"[=:][\x20\t]{0,3}(?:\"([^\"\s]{1,200})\"|'([^'\s]{1,200})'|([^\s\"'=:]{1,200}))")
#: A key at the end of what stands before a value.
KEY_BEFORE = re.compile(r"([^\W\d][\w.-]{0,63})[\"']?[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"'(\[{<]{0,2}\Z")
#: What a key's name may hold, and what it may begin with.
KEY_PART, KEY_HEAD = re.compile(r"[\w.-]"), re.compile(r"[^\W\d]")
EDGES = "\"'()[]{}<>,.;:!?"
HEX = re.compile(r"[0-9a-fA-F]{24,}")
MIXED = re.compile(r"[A-Za-z0-9_+/=-]{20,}")

#: A pattern needs so many different instances, and this share of all mentions of its words.
MIN_INSTANCES, MIN_CONFIDENCE = 3, 0.6
#: Weight of a candidate by its shape alone.
SHAPE_WEIGHT = 0.9
#: A guard; rounds end when no pattern is new.
MAX_ROUNDS = 50
#: The longest word that is context.
WORD_CHARS = 64
#: Bits of the map of pattern words.
MAP_BITS = 1 << 21

FOUND = "rid long, doc_id long, kinds array<int>, starts array<int>, ends array<int>"
MENTIONS = "mentions array<struct<start: int, end: int, base: boolean, weight: double, instance: string, patterns: array<string>>>"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each reaches back from its @ over local characters, but not into the match before."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in EDGES:
        start += 1
    while end > start and text[end - 1] in EDGES:
        end -= 1
    return start, end


def key_before(text: str, start: int) -> str | None:
    """The key whose value begins at a place; a name that goes on further back than a key may be long is none."""
    key = KEY_BEFORE.search(text, max(0, start - 80), start)
    at = key.start(1) - 1 if key else -1
    while at >= 0 and KEY_PART.match(text[at]):
        if KEY_HEAD.match(text[at]):
            return None
        at -= 1
    return key and key[1]


def unknown_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Candidates that touch no base span, in order: tokens that look like identifiers, and values of keys."""
    found, at = set(), 0
    while m := DIGIT.search(text, at):
        start = m.start()
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        end = TOKEN.match(text, m.start()).end()
        at = end + 1
        if key := KEY.match(text[start:end]):
            start += key.end()
        start, end = trimmed(text, start, end)
        token = text[start:end]
        digits = sum(c.isdigit() for c in token)
        mixed = digits >= 3 and len(token) >= 6 and any(c.isalpha() for c in token)
        if digits >= 5 or mixed:
            found.add((start, end))
    if "=" in text or ":" in text:
        for m in VALUE.finditer(text):
            start, end = trimmed(text, *m.span(m.lastindex))
            if start < end and key_before(text, start):
                found.add((start, end))
    # Of overlapping candidates the first stays; base spans are in order too.
    out, last, k = [], 0, 0
    for start, end in sorted(found):
        while k < len(known) and known[k][2] <= start:
            k += 1
        if start >= last and not (k < len(known) and known[k][0] < end):
            out.append((start, end))
            last = end
    return out


def shape_weight(token: str) -> float:
    """How much a token's shape alone tells: words and numbers have none of these."""
    digits, letters = sum(c.isdigit() for c in token), sum(c.isalpha() for c in token)
    if HEX.fullmatch(token) and min(digits, letters) >= 4:
        return SHAPE_WEIGHT
    if MIXED.fullmatch(token) and digits >= 3 and token.upper() != token != token.lower():
        return SHAPE_WEIGHT
    return 0.0


def normal(word: str) -> str:
    return DIGIT.sub("0", word.lower())


def words_before(text: str, start: int, count: int) -> list[str]:
    """Up to `count` whole words right before a place, none of over WORD_CHARS characters."""
    out: list[str] = []
    while len(out) < count:
        end = start
        while end > 0 and text[end - 1].isspace():
            end -= 1
        start = end
        while start > 0 and end - start <= WORD_CHARS and not text[start - 1].isspace():
            start -= 1
        if not 0 < end - start <= WORD_CHARS:
            break
        out.insert(0, normal(text[start:end]))
    return out


def word_after(text: str, end: int) -> str | None:
    """The first whole word after the one that a mention ends in."""
    n = 0
    while end < len(text) and not text[end].isspace():
        end, n = end + 1, n + 1
        if n > WORD_CHARS:
            return None
    while end < len(text) and text[end].isspace():
        end += 1
    start = end
    while end < len(text) and end - start <= WORD_CHARS and not text[end].isspace():
        end += 1
    return normal(text[start:end]) if 0 < end - start <= WORD_CHARS else None


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a mention: its key, or else the words before and after."""
    if key := key_before(text, start):
        return [f"K {normal(key)}"]
    if start > 0 and not text[start - 1].isspace() and text[start - 1] not in EDGES:
        return []  # within a word
    glued = start
    while glued > 0 and text[glued - 1] in EDGES:
        glued -= 1
    b, a = words_before(text, glued, 2), word_after(text, end)
    out = []
    if b:
        out.append(f"L {b[-1]}")
        if len(b) == 2:
            out.append(f"M {b[0]} {b[1]}")
    if a:
        out.append(f"R {a}")
    if b and a:
        out.append(f"B {b[-1]} {a}")
    return out


def mentions(text: str, known: list[tuple[int, int, int]]) -> list[dict]:
    """All candidates of a text with their weights and patterns."""
    rows = [(s, e, True) for s, _, e in known] + [(s, e, False) for s, e in unknown_spans(text, known)]
    name = lambda t: hashlib.blake2b(t.lower().encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
    return [{"start": s, "end": e, "base": base, "weight": 1.0 if base else shape_weight(text[s:e]), "instance": name(text[s:e]), "patterns": patterns(text, s, e)} for s, e, base in rows]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans of each row, and its candidates with their patterns as nested lists."""
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("weight", pa.float64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
    for batch in batches:
        for at in range(0, len(batch), 1000):
            some = batch.slice(at, 1000)
            texts = [t.as_py() or "" for t in some.column("text")]
            spans = [base_spans(t) for t in texts]
            found = [mentions(t, x) for t, x in zip(texts, spans)]
            columns = [pa.array([[x[k] for x in one] for one in spans], pa.list_(pa.int32())) for k in (1, 0, 2)]
            yield pa.RecordBatch.from_arrays([some.column("rid"), some.column("doc_id"), *columns, pa.array(found, pa.list_(item))], names=["rid", "doc_id", "kinds", "starts", "ends", "mentions"])


def bit(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % MAP_BITS


def _counter(bits: np.ndarray):
    """Counts, in each batch, of the words and pairs of words that the map has."""
    has = lambda key: bits[(b := bit(key)) >> 3] >> (b & 7) & 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[str] = Counter()
            known: dict[str, int] = {}
            for t in batch.column(0):
                words = DIGIT.sub("0", (t.as_py() or "").lower()).split()
                for w, c in Counter(words).items():
                    if w not in known:
                        # 1: counted alone, 2: the first word of a pair.
                        known[w] = (2 * has(f"H {w}") + has(f"L {w}")) if len(w) <= WORD_CHARS else 0
                    if known[w] & 1:
                        n[f"L {w}"] += c
                heads = [i for i, w in enumerate(words) if known[w] > 1]
                for kind, gap in (("M", 1), ("B", 2)):
                    n.update(filter(has, (f"{kind} {words[i]} {words[i + gap]}" for i in heads if i + gap < len(words))))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["words", "n"])

    return run


def word_map(words: DataFrame) -> np.ndarray:
    """A map of MAP_BITS bits of the column `words`, whatever their number: at most so many places come to the driver."""
    places = words.select(F.pmod(F.crc32(F.col("words").cast("binary")), F.lit(MAP_BITS)).cast("int").alias("place")).distinct().toArrow().column("place").to_numpy()
    bits = np.zeros(MAP_BITS, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little")


def word_totals(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(pattern, total): how often the words of each pattern stand in the corpus.

    Words after count as words before do; all values of keys are candidates, so their mentions are their total.
    """
    words = F.when(F.col("pattern").startswith("R "), F.concat(F.lit("L "), F.substring("pattern", F.lit(3), F.length("pattern")))).otherwise(F.col("pattern"))
    enough = edges.groupBy("pattern").agg(F.count("*").alias("_i"), F.sum("n").alias("_n")).where(F.col("_i") >= MIN_INSTANCES).withColumn("words", words)
    enough = stored(enough, "patterns")
    free = enough.where(~F.col("pattern").startswith("K "))
    # The first word of a pair is looked up before the pair is.
    heads = free.where(F.substring("pattern", 1, 2).isin("M ", "B ")).select(F.concat(F.lit("H "), F.split("pattern", " ")[1]).alias("words"))
    bits = word_map(free.select("words").unionByName(heads))
    counted = docs.select("text").mapInArrow(_counter(bits), "words string, n long").groupBy("words").agg(F.sum("n").alias("_c"))
    totals = free.join(counted, "words", "left").select("pattern", F.greatest(F.coalesce("_c", F.lit(0)), "_n").alias("total"))
    return totals.unionByName(enough.where(F.col("pattern").startswith("K ")).select("pattern", F.col("_n").alias("total")))


def confident_patterns(edges: DataFrame, totals: DataFrame) -> DataFrame:
    """(pattern, confidence) of those that hold once no other joins them.

    edges (pattern, instance, own, n): mentions of an instance in a pattern, and the instance's own weight.
    """
    edges = stored(edges.join(totals, "pattern"), "pattern-graph")
    weights = edges.groupBy("instance").agg(F.max("own").alias("weight"))
    chosen, before = None, 0
    for _ in range(MAX_ROUNDS):
        seen = edges.join(weights, "instance")
        support = seen.groupBy("pattern").agg(F.sum(F.col("n") * F.col("weight")).alias("_s"), F.max("total").alias("_t"), F.count_if(F.col("weight") >= MIN_CONFIDENCE).alias("_i"))
        # One more mention in the total keeps rare patterns from being certain.
        chosen = stored(support.where(F.col("_i") >= MIN_INSTANCES).select("pattern", (F.col("_s") / (F.col("_t") + 1)).alias("confidence")).where(F.col("confidence") >= MIN_CONFIDENCE), "confident")
        if (now := chosen.count()) == before:
            break
        before = now
        doubt = F.exp(F.sum(F.ln(F.greatest(1 - F.coalesce("confidence", F.lit(0.0)), F.lit(1e-9)))))
        scored = edges.join(chosen, "pattern", "left").groupBy("instance").agg(F.max("own").alias("_own"), doubt.alias("_d"))
        weights = stored(scored.select("instance", (1 - (1 - F.col("_own")) * F.col("_d")).alias("weight")), "instance-weights")
    return chosen


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, base, added): spans (start, kind, end), kind by its place in KINDS."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(rows.mapInArrow(_find, f"{FOUND}, {MENTIONS}"), "found")
    seen = found.select("rid", F.explode("mentions").alias("m")).select("rid", "m.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    edges = seen.groupBy("pattern", "instance").agg(F.max("weight").alias("own"), F.count("*").alias("n"))
    chosen = confident_patterns(edges, word_totals(docs, edges))
    hits = seen.where(~F.col("base")).join(small_or_shuffled(chosen.select("pattern")), "pattern", "left_semi")
    added = hits.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", F.lit(KINDS.index("id")).alias("kind"), "end"))).alias("added"))
    base = F.zip_with(F.arrays_zip("starts", "kinds"), "ends", lambda a, e: F.struct(a["starts"].alias("start"), a["kinds"].alias("kind"), e.alias("end")))
    return found.select("rid", "doc_id", base.alias("base")).join(added, "rid", "left").select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<start: int, kind: int, end: int>>")).alias("added"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*map(F.lit, KINDS))
    listed = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    digest = F.sha2(listed(F.col("base")).cast("binary"), 256)
    every = F.concat("base", "added")
    return out.select("doc_id", *[count(k).alias(f"n_{x}") for k, x in enumerate(KINDS[:4])], digest.alias("base_sha256"), listed(every).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(every).cast("long").alias("n_spans"))
