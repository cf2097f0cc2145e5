"""Language identification by nearest centroid (operator 7).

A text's letters, in lower case, with one blank for every run of anything else, give byte pairs and triples, hashed into
two ranges of a vector. Counts are damped (1 + log), weighted by inverse document frequency and brought to length one.
Document frequencies are counted over all training documents. Each language has several centroids, found by spherical
k-means over at most `SAMPLE` of its training documents (those with the least hashed ids), in the workers, one task a language;
the driver sees centroids alone. A document gets the language of the centroid with the largest cosine. It is marked as
rejected if its distance from that centroid is beyond the centroid's radius, the largest distance of the sample's members
times `SLACK`.

Defined cases: a null text and a text without letters are `und` with score 0; training skips null languages and texts
without letters; of more than `LANGUAGES` languages the most frequent are learned; without any training document all are
`und`; the first of equal centroids wins, in order of language; an empty table gives an empty result; lang, source and
doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fold, table

RANGE_BITS = 12
DIM = 2 << RANGE_BITS
#: Training documents of a language that k-means sees, and languages that are learned, which bound the model (128 kB a
#: language). Frequencies are counted over all.
SAMPLE, LANGUAGES = 300, 500
CENTROIDS, SLACK = 4, 1.5
_TO_BLANK = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))


def grams(text: str | None) -> np.ndarray | None:
    """Counts of hashed byte pairs and triples, or None without letters."""
    if not text or not any(map(str.isalpha, text)):
        return None
    words = text.lower().encode().translate(_TO_BLANK).split()
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    pairs = (raw[:-1] << np.uint32(8)) | raw[1:]
    triples = (pairs[:-1] << np.uint32(8)) | raw[2:]
    down = np.uint32(32 - RANGE_BITS)
    counts = np.bincount((pairs * np.uint32(2654435761)) >> down, minlength=DIM)
    counts[1 << RANGE_BITS :] = np.bincount((triples * np.uint32(2246822519)) >> down, minlength=1 << RANGE_BITS)
    return counts


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return (x / np.sqrt((x * x).sum())).astype(np.float32)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    languages: list[str]  # one for each centroid
    centroids: np.ndarray
    radius: np.ndarray


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and their radii, by spherical k-means; seeds are drawn by a fixed generator from the distinct rows."""
    x = x[np.lexsort(x.T)]  # the same sums whatever the rows' order
    distinct = np.unique(x, axis=0)
    centres = distinct[np.random.default_rng(5).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.array([x[own == i].sum(axis=0) if (own == i).any() else c for i, c in enumerate(centres)])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    cosine = x @ centres.T
    own = cosine.argmax(axis=1)
    radius = np.array([1 - cosine[own == i, i].min() if (own == i).any() else 0.0 for i in range(len(centres))])
    return centres.astype(np.float32), radius


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of the rows (text) have each hashed n-gram, and how many have letters. A partition sends one row."""

    def count(batches):
        seen, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                if (c := grams(t.as_py())) is not None:
                    seen += c > 0
                    n += 1
        yield pa.RecordBatch.from_pylist([{"v": [n, *seen.tolist()]}], pa.schema([("v", pa.list_(pa.int64()))]))

    parts = texts.mapInArrow(count, "v array<bigint>")
    summed = np.zeros(DIM + 1, np.int64)
    for r in parts.select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("v")).collect():  # DIM + 1 rows
        summed[r["pos"]] = r["v"]
    return summed[1:], int(summed[0])


def _vectors(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """lang, v array<float> for the rows (lang, text) with letters."""
    spec = rows.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        for batch in batches:
            found = [(lang, vector(c, spec.value)) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1)) if (c := grams(t.as_py())) is not None]
            flat = np.concatenate([v for _, v in found]) if found else np.zeros(0, np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * DIM, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in found], pa.string()), lists], ["lang", "v"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, v array<float>")


def _clustered(vectors: DataFrame, centroids: int) -> DataFrame:
    """lang, centres (as bytes) and radius of each language; a task holds one language's sample."""

    def run(group: pa.Table) -> pa.Table:
        x = np.asarray(group.column("v").combine_chunks().flatten(), np.float32).reshape(-1, DIM)
        centres, radius = cluster(x, centroids)
        return pa.table({"lang": group.column("lang")[:1].cast(pa.string()), "centres": pa.array([centres.tobytes()], pa.binary()), "radius": pa.array([radius.tolist()], pa.list_(pa.float64()))})

    return vectors.groupBy("lang").applyInArrow(run, "lang string, centres binary, radius array<double>")


def train(rows: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, languages: int = LANGUAGES) -> Model | None:
    """A model from rows (doc_id, text, lang)."""
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    seen, n = document_frequencies(rows.select("text"))
    if not n:
        return None
    idf = np.log((1 + n) / (1 + seen)) + 1
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    order = F.xxhash64("doc_id", F.lit(7))
    share = F.create_map(*(F.lit(v) for lang, c in sizes.items() for v in (lang, min(1.0, 2 * sample / c))))
    # thinned by the hash first, so that no task ranks a whole language
    thin = rows.filter(F.pmod(order, F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    ranked = thin.withColumn("__rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(order, F.lit(1 << 20)), order, "text"))).filter(F.col("__rank") <= sample)
    chosen = cut(_vectors(ranked, idf), "language-sample")
    names, found, radii = [], [], []
    for r in sorted(_clustered(chosen, centroids).collect(), key=lambda r: r["lang"]):  # one row a language
        names += [r["lang"]] * len(r["radius"])
        found.append(np.frombuffer(r["centres"], np.float32).reshape(-1, DIM))
        radii.append(np.array(r["radius"]))
    return Model(idf, names, np.concatenate(found), np.concatenate(radii)) if found else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row."""
    spec = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = spec.value
        for batch in batches:
            lang, score, far = [], [], []
            for t in batch.column(1):
                c = None if m is None else grams(t.as_py())
                if c is None:
                    lang.append("und")
                    score.append(0.0)
                    far.append(True)
                    continue
                cosine = m.centroids @ vector(c, m.idf)
                best = int(cosine.argmax())
                lang.append(m.languages[best])
                score.append(float(min(1.0, max(0.0, cosine[best]))))
                far.append(bool(1 - cosine[best] > SLACK * m.radius[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang").filter(fold(F.col("doc_id"), 4) != 2))
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
