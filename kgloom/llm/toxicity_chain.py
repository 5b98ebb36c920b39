"""Toxicity by a classifier chain of linear models.

Categories are predicted in a given order.  A category is a column of ``labels``, or, where those do not tell it, a weak label: a
pattern that the lower-cased text of a labelled row has or has not (``WEAK``).  Each has a logistic model over the presence of selected words and
word stems (leading bytes) and the logits of the categories before it; those inputs are out-of-fold predictions while fitting, so a later
model sees earlier ones as good as they are on new texts.  A category's words are those whose presence in the sampled
texts is associated with it beyond chance (G statistic), kept by their whole 64-bit hash, so no other word takes
their place.  Fitted on at most ``max_rows`` labelled rows; counts are aggregated by Spark, and the driver
gets at most ``max_words`` words for each category and the sample's hits on them.

Defined cases: null or empty texts have no words; without labels, or with one class of a category only, its
probability is the share of label 1 (0 with no labels); long texts are read whole; equal rows get equal
results; other columns are ignored.  A mark of 1 counts ``weight`` times in the fit, as missing a toxic text costs more
than checking a clean one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import U, slices
from .features import StemIndex, sample_rows, sigmoid, unique_stems
from .shared import sparing, stored


#: Weak labels: words of abuse in the four languages (fixed values), by their beginnings, and text in capitals under exclamation marks.
WEAK = {
    "insult": r"\b(?:idiot|moron|imbecil|imbécil|stupid|stupide|dumb|fool|loser|clown|scum|trash|pathetic|worthless|disgusting|jerk|dumm|blöd|trottel|versager|abschaum|widerlich|erbärmlich|idiota|estúpid|payaso|basura|escoria|patétic|asqueros|crétin|ordure|minable|pathétique|dégoûtant)",
    "shouting": r"(?:\w+[,.]?!!+\s+){3}",
}


class _Sums:
    """Sums over the segments of ``sizes`` entries of ``values[at]``, gathered some entries at a time."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray, step: int = 1 << 18) -> None:
        self.at, self.n, self.some = at, len(sizes), np.flatnonzero(sizes)
        ends = np.cumsum(sizes)[self.some]
        self.starts = ends - sizes[self.some]
        cut = np.unique(np.searchsorted(self.starts, np.arange(0, max(1, len(at)), step)))
        self.runs = [(i, j, self.starts[i], ends[j - 1]) for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(self.some)], strict=True) if i < j]

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for i, j, a, b in self.runs:
            out[self.some[i:j]] = np.add.reduceat(values.take(self.at[a:b]), self.starts[i:j] - a)
        return out


def fit_linear(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, n: int, l2: float = 0.2, steps: int = 100, weight: float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic regression (bias, word weights, extra weights) on sets of present columns, by accelerated descent."""
    share = y.mean() if len(y) else 0.0
    if not 0 < share < 1:
        return (40.0 if share else -40.0), np.zeros(n), np.zeros(extra.shape[1])
    each = np.where(y > 0, weight, 1.0)
    share = (each * y).sum() / each.sum()
    size = np.array([len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int32, copy=False)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    each_col = np.bincount(col, minlength=n)
    # by rows and by columns, so each pass is a gather and a run of sums
    of_rows, of_cols = _Sums(col, size), _Sums(row[np.argsort(col, kind="stable")], each_col)
    del row
    w = np.zeros(1 + extra.shape[1] + n)
    w[0] = np.log(share / (1 - share))
    k = 1 + extra.shape[1]
    fixed = np.column_stack([np.ones(len(y)), extra])
    damp = np.full(len(w), l2)
    damp[0] = 1e-3
    # step from a bound on the curvature of each weight's row sums
    degree = (np.abs(fixed).sum(1) + size)
    degree = degree * each
    curve = np.concatenate([(np.abs(fixed) * degree[:, None]).sum(0), of_cols.of(degree)]) / 4 + damp
    look, prev = w.copy(), w.copy()
    for t in range(steps):
        p = sigmoid(fixed @ look[:k] + of_rows.of(look[k:]))
        err = each * (p - y)
        grad = np.concatenate([fixed.T @ err, of_cols.of(err)]) + damp * look
        w = look - grad / curve
        look = w + t / (t + 3) * (w - prev)
        prev = w
    return float(w[0]), w[k:], w[1:k]


@dataclass
class ClassifierChain:
    names: list[str]
    words: np.ndarray
    bias: list[float] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    weight: float = 1.0
    earlier: list[np.ndarray] = field(default_factory=list)
    _index: StemIndex | None = None

    def hits(self, column) -> list[np.ndarray]:
        if self._index is None:
            self._index = StemIndex(self.words)
        return [h for part in slices(column) for h in self._index.hits(part)]

    def logits(self, hits: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(hits), len(self.names)))
        for c in range(len(self.names)):
            own = np.array([self.weights[c][h].sum() for h in hits]) if hits else np.zeros(0)
            out[:, c] = np.clip(self.bias[c] + own + out[:, :c] @ self.earlier[c], -40, 40)
        return out

    def probabilities(self, column) -> np.ndarray:
        return sigmoid(self.logits(self.hits(column)))

    def fit(self, hits: list[np.ndarray], y: np.ndarray, folds: np.ndarray) -> ClassifierChain:
        earlier = np.zeros((len(hits), 0))
        for c in range(len(self.names)):
            held = np.zeros(len(hits))
            for f in np.unique(folds):
                inside, out = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
                b, w, e = fit_linear([hits[i] for i in inside], earlier[inside], y[inside, c], len(self.words), weight=self.weight)
                held[out] = np.clip(b + np.array([w[hits[i]].sum() for i in out]) + earlier[out] @ e, -40, 40)
            b, w, e = fit_linear(hits, earlier, y[:, c], len(self.words), weight=self.weight)
            self.bias.append(b)
            self.weights.append(w)
            self.earlier.append(e)
            earlier = np.column_stack([earlier, held])
        return self


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], max_rows: int = 16_000, max_words: int = 1500, least_g: float = 11.0, weight: float = 2.0, weak: Mapping[str, str] = WEAK) -> ClassifierChain:
    """Fit the categories, columns of ``labels`` with 0 or 1 or else names in ``weak``, in the given order.

    ``least_g`` (with 3 texts or more) is what sets a word apart from chance, ``max_words`` bounds the model that is sent.
    """
    names = list(categories)
    known, rules = [c for c in names if c in labels.columns], {c: re.compile(weak[c]) for c in names if c not in labels.columns}
    chosen = F.broadcast(sample_rows(labels, known, max_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for part in slices(batch.column("text")):
                found, at = unique_stems(part)
                rows = batch.slice(start, len(part))
                start += len(part)
                lowered = [(x or "").lower() for x in part.to_pylist()] if rules else []
                marks = {c: pa.array([int(bool(rule.search(x))) for x in lowered], pa.int32()) for c, rule in rules.items()}
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(marks[c] if c in marks else rows.column(c) for c in names), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.view(np.int64)))], names=["doc_id", *names, "words"])

    kind = ", ".join(f"`{c}` int" for c in names)
    sample = stored(texts.select("doc_id", *known, "text").mapInArrow(sparing(words), f"doc_id long, {kind}, words array<long>"), "chain-sample")
    totals = sample.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in names)).first()
    n = totals["n"]
    seen = stored(sample.select(*names, F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in names)).filter("n >= 3"), "chain-words")

    def term(got, expected):
        return F.when(got > 0, got * F.log(got / expected)).otherwise(0.0)

    kept = set()
    for c in names:
        pos = totals[c] or 0
        if not 0 < pos < n:
            continue
        a, b = F.col(c), F.col("n") - F.col(c)
        rest_a, rest_b = F.lit(pos) - a, F.lit(n - pos) - b
        g = 2 * (term(a, F.col("n") * pos / n) + term(b, F.col("n") * (n - pos) / n) + term(rest_a, (n - F.col("n")) * pos / n) + term(rest_b, (n - F.col("n")) * (n - pos) / n))
        kept |= {x["word"] for x in seen.select("word", g.alias("g")).filter(F.col("g") >= least_g).orderBy(F.desc("g"), "word").limit(max_words).collect()}
    chain = ClassifierChain(names, np.sort(np.array(sorted(kept), np.int64).view(U)) if kept else np.zeros(0, U), weight=weight)
    known_words = chain.words

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            h = lists.flatten().to_numpy().view(U)
            p = np.minimum(np.searchsorted(known_words, h), len(known_words) - 1)
            has = known_words[p] == h if len(known_words) else np.zeros(len(h), bool)
            ends = np.concatenate([[0], np.cumsum(has)])[np.concatenate([[0], np.cumsum(lists.value_lengths())])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "fold", *names)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(p[has], pa.int32()))], names=["doc_id", "fold", *names, "places"])

    # as Arrow columns: a few MB, where rows of Python lists would be many times that
    rows = sample.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold"), *names, "words").mapInArrow(sparing(places), f"doc_id long, fold long, {kind}, places array<int>").toArrow().sort_by("doc_id").combine_chunks()
    if not rows.num_rows:
        return chain.fit([], np.zeros((0, len(names))), np.zeros(0))
    lists = rows["places"].combine_chunks()
    hits = np.split(lists.flatten().to_numpy().copy(), np.cumsum(np.asarray(lists.value_lengths()))[:-1])
    y, folds = np.stack([rows[c].to_numpy().astype(float) for c in names], 1), rows["fold"].to_numpy().copy()
    del rows, lists  # the fit needs the places alone
    pa.default_memory_pool().release_unused()
    return chain.fit(hits, y, folds)


def score_chain(docs: DataFrame, chain: ClassifierChain, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id (or the ``keep`` columns instead) and p_<category> for each category."""
    keep = list(keep) or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    inside = [f"kept_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sent.value.probabilities(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in inside), *(pa.array(p[:, i]) for i in range(p.shape[1]))], names=[*inside, *(f"p{i}" for i in range(p.shape[1]))])

    rows = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, inside, strict=True)), "text")
    kind = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in inside] + [f"p{i} double" for i in range(len(chain.names))])
    found = rows.mapInArrow(sparing(run), kind)
    return found.select(*(F.col(k).alias(c) for c, k in zip(keep, inside, strict=True)), *(F.col(f"p{i}").alias(f"p_{c}") for i, c in enumerate(chain.names)))


def drop_toxic(docs: DataFrame, chain: ClassifierChain, category: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose probability of ``category`` reaches ``threshold``; no row moves."""
    sent, c = docs.sparkSession.sparkContext.broadcast(chain), chain.names.index(category)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for part in slices(batch.column("text")):  # a slice goes out before the next is read, so a batch is not held twice
                rows = batch.slice(start, len(part))
                start += len(part)
                yield rows.filter(pa.array(sent.value.probabilities(part)[:, c] < threshold))

    return docs.mapInArrow(sparing(run), docs.schema)
