"""Quality classifier: regularised quadratic discriminant analysis over document statistics (operator 2).

Each whole text gives a vector of transformed statistics (logarithms of sizes, square roots of shares). The training rows'
counts, sums and sums of products per class are added up over all partitions; means and covariances follow from them
alone, so training covers every labelled row with memory of one d x d matrix. Covariances are shrunk twice: towards the
pooled covariance and towards its diagonal. A score is the posterior of class 1 from the difference of the two log
densities, whose Mahalanobis terms are products with the inverses of the Cholesky factors, which are computed once and sent
to the workers. The difference is divided by `temper`, since the statistics depend on one another and plain
differences are overconfident.

Defined cases: a null or empty text is scored as a text of no words; unlabelled rows and null labels do not train; a doc_id
with several labels trains once for each; without both classes in the training rows every score is the share of class 1
(0.5 without any); an empty table gives an empty result; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import log, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold, table

UPPER, LOWER, DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
SYMBOLS, MARKS = b"#*$%&<>@\\^~_=+{}[]|/`", b".,;:?!-'\"()"
STATISTICS = ("words", "word_length", "long_words", "upper", "digits", "symbols", "marks", "other", "distinct", "repeated", "same_next", "same_next_but_one", "line_words", "dup_lines", "mark_runs")
_MARK_RUN = re.compile(rb"[!-/:-@\[-`{-~]{2,}")


#: Added to the base of each share, so that a few words are no strong evidence.
DAMP = 20


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS for one whole text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    size = len(raw)
    without = lambda chars: size - len(raw.translate(None, chars))
    upper, lower, digits, symbols, marks = map(without, (UPPER, LOWER, DIGIT, SYMBOLS, MARKS))
    chars = sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda k, of: sqrt(k / (of + DAMP))
    return [
        log1p(n),
        log((chars + 5 * DAMP) / (n + DAMP)),
        share(sum(1 for w in words if len(w) > 14), n),
        share(upper, chars),
        share(digits, chars),
        share(symbols, chars),
        share(marks, chars),
        share(max(0, chars - upper - lower - digits - symbols - marks), chars),
        log((len(counts) + DAMP) / (n + DAMP)),
        share(max(counts.values(), default=0), n),
        share(sum(map(bytes.__eq__, words, words[1:])), n),
        share(sum(map(bytes.__eq__, words, words[2:])), n),
        log1p(n / max(1, len(lines))),
        share(len(lines) - len(set(lines)), len(lines)),
        share(len(_MARK_RUN.findall(raw)), n),
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id, x array<double> for every row."""

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(1)]).reshape(-1, len(STATISTICS))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass(frozen=True)
class Model:
    """Per class: log prior, mean, the Cholesky factor's inverse and the log determinant. Without both classes: a constant."""

    prior: np.ndarray
    means: np.ndarray | None = None
    whitening: np.ndarray | None = None
    log_det: np.ndarray | None = None
    temper: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1."""
        if self.means is None:
            return np.full(len(x), self.prior[1])
        log_density = [-0.5 * (((x - self.means[c]) @ self.whitening[c].T) ** 2).sum(axis=1) - 0.5 * self.log_det[c] for c in (0, 1)]
        odds = np.log(self.prior[1] / self.prior[0]) + (log_density[1] - log_density[0]) / self.temper
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(counts: dict[int, float], sums: dict[int, np.ndarray], products: dict[int, np.ndarray], *, pooled: float = 0.2, diagonal: float = 0.1, temper: float = 3.0) -> Model:
    """A model from each class's count, sum and sum of outer products of statistics."""
    total = counts.get(0, 0) + counts.get(1, 0)
    if not counts.get(0) or not counts.get(1):
        share = counts.get(1, 0) / total if total else 0.5
        return Model(np.array([1 - share, share]))
    means = {c: sums[c] / counts[c] for c in (0, 1)}
    spread = {c: products[c] / counts[c] - np.outer(means[c], means[c]) for c in (0, 1)}
    common = sum(counts[c] * spread[c] for c in (0, 1)) / total
    ridge = 1e-4 * np.eye(len(common))
    factors = []
    for c in (0, 1):
        # a class of few rows leans more on what both have in common
        lean = max(pooled, len(common) / (len(common) + counts[c]))
        s = (1 - lean) * spread[c] + lean * common
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s))
        factors.append(np.linalg.cholesky(s + ridge))
    prior = np.array([counts[0], counts[1]]) / total
    whitening = np.array([np.linalg.inv(f) for f in factors])  # once; rows are then scored by a product
    return Model(prior, np.array([means[0], means[1]]), whitening, np.array([2 * np.log(np.diag(f)).sum() for f in factors]), temper)


def train(rows: DataFrame, **options: float) -> Model:
    """A model from all rows (x, label 0 or 1); each partition sends one row a class."""
    d = len(STATISTICS)

    def add(batches):
        kept = {c: [0.0, np.zeros(d), np.zeros((d, d))] for c in (0, 1)}
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, d)
            y = np.asarray(batch.column(1))
            for c, k in kept.items():
                part = x[y == c]
                k[0] += len(part)
                k[1] += part.sum(axis=0)
                k[2] += part.T @ part
        out = [(c, [n, *s, *p.ravel()]) for c, (n, s, p) in kept.items() if n]
        yield pa.RecordBatch.from_pylist([{"label": c, "v": v} for c, v in out], pa.schema([("label", pa.int32()), ("v", pa.list_(pa.float64()))]))

    parts = rows.select("x", F.col("label").cast("int").alias("label")).mapInArrow(add, "label int, v array<double>")
    # summed by position before anything comes to the driver: 1 + d + d * d numbers a class
    summed = parts.select("label", F.posexplode("v")).groupBy("label", "pos").agg(F.sum("col").alias("v")).collect()
    flat = {c: np.zeros(1 + d + d * d) for c in {r["label"] for r in summed}}
    for r in summed:
        flat[r["label"]][r["pos"]] = r["v"]
    return fit({c: v[0] for c, v in flat.items()}, {c: v[1 : 1 + d] for c, v in flat.items()}, {c: v[1 + d :].reshape(d, d) for c, v in flat.items()}, **options)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for rows (doc_id, x)."""
    spec = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spec.value.scores(x))], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(described(table(spark, sf_dir, "documents")), "described")
    labels = table(spark, sf_dir, "labels").filter("quality IN (0, 1)").select("doc_id", F.col("quality").alias("label"))
    model = train(rows.join(labels.filter(fold(F.col("doc_id"), 5) != 0), "doc_id"))
    return score(rows, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
