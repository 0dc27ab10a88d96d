"""Quality classifier: a generalised additive model with pairwise interactions.

Training takes a bounded sample of labelled documents (SAMPLE_ROWS, those with the
least hash of their id, so it is the same in every run). Features are cut into
quantile bins; boosting goes round the features in turn, each time fitting a shallow
tree over one feature's bins to the residuals and adding a small step of it to that
feature's lookup table. Then the pairs of features whose joint residuals promise most
get tables of their own, boosted the same way. A score is the logistic of a sum of
table entries, looked up for whole batches at once.

Nulls and ties: null and empty texts have all features 0 and are scored like any
other; labels that are null are left out; a document with several labels trains with
each; repeated rows score alike, and where repeated ids make more rows than the bound,
those with the least hash train the model. A very long text is read whole. Without labelled rows every score is 0.5. An empty
table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_or_shuffled, stored, table

#: At most so many labelled rows train the model.
SAMPLE_ROWS = 20_000
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
BINS, PAIR_BINS, PAIRS, LEAVES = 24, 6, 6, 3
FOLDS = 5
THRESHOLD = 0.3
FEATURES = ("n_words", "word_length", "upper_share", "digit_share", "symbol_share", "pipe_share", "bang_share", "punct_share", "unique_share", "top_share", "repeat_share", "dup_line_share", "words_a_line", "stop_share", "non_ascii_share", "worst_line")
SYMBOLS = frozenset(b"#*$%&<>@^~=_\\{}")
PUNCT = frozenset(b".,;:?'\"()-")
#: Frequent short words of the four languages.
STOP_WORDS = frozenset(b"the of and to in a is that for it as with on by this be are was or an de la le et les des en un une est que qui dans pour du au der die und das von zu mit ist nicht den im el los las y del se por con no para".split())


def _masks() -> dict[str, np.ndarray]:
    make = lambda chars: np.isin(np.arange(256), list(chars)).astype(np.float64)
    return {"upper": make(range(65, 91)), "lower": make(range(97, 123)), "digit": make(range(48, 58)), "symbol": make(SYMBOLS), "pipe": make(b"|"), "bang": make(b"!"), "punct": make(PUNCT), "high": make(range(128, 256))}


MASKS = _masks()


def features(text: str) -> list[float]:
    """The features of a whole text, in the order of FEATURES."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    c = {k: float(counts @ m) for k, m in MASKS.items()}
    chars = sum(map(len, words))
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = sum(map(operator.eq, words, words[1:]))
    stops = sum(seen.get(w, 0) for w in STOP_WORDS)
    odd = 0.0  # the largest share of marks in a line of five words or more
    for line in set(lines):
        if len(line) >= 25:
            k = sum(map(line.count, (b"!", b"|", b"$", b"%", b"*", b"#", b"&")))
            odd = max(odd, k / (line.count(b" ") + 1))
    return [
        float(n), chars / n, c["upper"] / (c["upper"] + c["lower"] + 1), c["digit"] / chars, c["symbol"] / chars, c["pipe"] / n, c["bang"] / n, c["punct"] / n,
        len(seen) / n, max(seen.values()) / n, repeats / n, 1 - len(set(lines)) / len(lines), n / len(lines), stops / n, c["high"] / chars, odd,
    ]


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([features(t.as_py() or "") for t in batch.column("text")], np.float64).reshape(-1, len(FEATURES))
        rest = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, *map(pa.array, x.T)], names=[*rest.schema.names, *FEATURES])


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, the features) of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_feature_batches, "doc_id long, " + ", ".join(f"{x} double" for x in FEATURES))


@dataclass
class Model:
    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (cuts, t) in enumerate(zip(self.cuts, self.tables)):
            total += t[np.searchsorted(cuts, x[:, k], side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            total += t[np.searchsorted(self.pair_cuts[i], x[:, i], side="right"), np.searchsorted(self.pair_cuts[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Edges at quantiles; values that many rows share (0 above all) have bins of their own."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values of a tree of so many leaves over ordered bins with gradient and curvature sums g and h."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-6, -1, 0)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                tg, th = g[a:b].sum(), h[a:b].sum()
                gains = _gain(cg, ch) + _gain(tg - cg, th - ch) - _gain(tg, th)
                at = int(np.argmax(gains))
                best = max(best, (float(gains[at]), k, a + at + 1))
        if best[1] < 0:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree over a grid: the best cut of one feature, then of the other on each side."""
    best, where = -1.0, None
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            quads = [(slice(0, a), slice(0, b)), (slice(0, a), slice(b, None)), (slice(a, None), slice(0, b)), (slice(a, None), slice(b, None))]
            g00, g0, g_0, gt = cg[a - 1, b - 1], cg[a - 1, -1], cg[-1, b - 1], cg[-1, -1]
            h00, h0, h_0, ht = ch[a - 1, b - 1], ch[a - 1, -1], ch[-1, b - 1], ch[-1, -1]
            total = _gain(g00, h00) + _gain(g0 - g00, h0 - h00) + _gain(g_0 - g00, h_0 - h00) + _gain(gt - g0 - g_0 + g00, ht - h0 - h_0 + h00)
            if total > best:
                best, where = float(total), quads
    out = np.zeros_like(g)
    for q in where or []:
        out[q] = g[q].sum() / (h[q].sum() + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of shallow trees over single features, then over the best pairs."""
    k = x.shape[1]
    cuts, pair_cuts = [_cuts(x[:, i], BINS) for i in range(k)], [_cuts(x[:, i], PAIR_BINS) for i in range(k)]
    rows = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)]
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    tables, total = [np.zeros(len(c) + 1) for c in cuts], np.full(len(y), base)
    slope = lambda: (y - (p := 1 / (1 + np.exp(-total))), p * (1 - p))
    for _ in range(ROUNDS):
        for i in range(k):
            g, h = slope()
            step = RATE * _shallow_tree(np.bincount(rows[i], g, len(tables[i])), np.bincount(rows[i], h, len(tables[i])), LEAVES)
            tables[i] += step
            total += step[rows[i]]
    small = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(pair_cuts)]
    sizes = [len(c) + 1 for c in pair_cuts]
    grid = lambda i, j, v: np.bincount(small[i] * sizes[j] + small[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    g, h = slope()
    ranked = sorted((-float(_gain(grid(i, j, g), grid(i, j, h)).sum()), i, j) for i in range(k) for j in range(i) if min(sizes[i], sizes[j]) > 1)
    pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for n, (i, j) in enumerate(pairs):
            g, h = slope()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))
            pair_tables[n] += step
            total += step[small[i], small[j]]
    return Model(cuts, base, tables, pair_cuts, pairs, pair_tables)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def sample_labels(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, _y) of the sample: labelled rows outside the held-out fold with the least hash of their id."""
    mine = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("_y"))
    return mine.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(rows)


def train(featured: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    picked = small_or_shuffled(sample_labels(labels, rows), rows)
    sample = featured.join(picked, "doc_id").select("doc_id", "_y", *FEATURES).orderBy(F.xxhash64("doc_id", *FEATURES), "doc_id", "_y", *FEATURES).limit(rows).toArrow()
    if not sample.num_rows:
        return None
    x = np.column_stack([sample.column(f).to_numpy() for f in FEATURES])
    return fit(x, sample.column("_y").to_numpy())


def scored(featured: DataFrame, model: Model | None) -> DataFrame:
    """featured with score in place of the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy() for f in FEATURES])
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return featured.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    featured = stored(with_features(docs), "quality-features")
    out = scored(featured, train(featured, labels))
    fold = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the model does not reject, with the columns of docs.

    The model comes from the labelled rows alone, so the texts are read once more to be scored.
    """
    wanted = small_or_shuffled(sample_labels(labels).select("doc_id"), SAMPLE_ROWS)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    model = train(stored(with_features(labelled), "quality-sample"), labels)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py() or "") for t in batch.column(at)], np.float64).reshape(-1, len(FEATURES))
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield batch.filter(pa.array(s >= THRESHOLD))

    return docs.select(*names).mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
