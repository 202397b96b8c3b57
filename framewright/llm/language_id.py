"""Language identification by the nearest centroid.

A text is the TF-IDF vector of its character n-grams (1 to 3 letters of lower-cased words with their borders), hashed to
``2^bits`` places, with square-root term frequencies and unit length. Each language has up to ``clusters`` centroids, found
by spherical k-means over a bounded sample of labelled texts. A text gets the language of the nearest centroid by cosine. If
its distance to that is above the radius that all but ``reject`` of the language's own sample texts keep, it is rejected: it
still names the nearest language, and ``rejected`` tells that it resembles none.

The sample holds ``max_fit_rows`` texts for each language at most in expectation, chosen by a hash; equal texts count once.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without labelled rows every text is ``und``
with score 0; rows with a null language teach nothing; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import durable, remainder, small
from ._text import mix

FOLDS, HELD_OUT = 3, 1
MAX_FIT_ROWS, CLUSTERS, BITS, REJECT = 600, 4, 13, 0.01
UNKNOWN = "und"
#: Letters that one pass over a text holds at once.
PIECE = 1 << 20
#: Languages that a task compares texts with at once (128 KB each); more are compared in further passes.
LANGUAGES_A_PASS = 250
SHARPNESS = 20.0


def _letter(c: int) -> int:
    """The lower-cased letter that a code point is, or 0."""
    x = chr(c)
    low = x.lower()
    return 0 if not x.isalpha() else ord(low) if len(low) == 1 else c


_table: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """The text's code points as lower-cased letters, others as 0."""
    if not _table:
        _table.append(np.array([_letter(c) for c in range(1 << 16)], dtype=np.uint32))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found = _table[0][points & np.uint32(0xFFFF)]
    beyond = points > 0xFFFF
    if beyond.any():
        values, place = np.unique(points[beyond], return_inverse=True)
        found[beyond] = np.array([_letter(int(c)) for c in values], dtype=np.uint32)[place]
    return found


def gram_counts(text: str, bits: int) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams of a whole text; None if it has no letter.

    Runs of other characters, and the ends of the text, count as one border (0). Long texts go by pieces; the last two units
    of what was read are carried on, so that it makes no difference where a piece ends.
    """
    size, total, any_letter = 1 << bits, None, False
    carried = np.zeros(1, np.uint64)
    for at in range(0, len(text) + 1, PIECE):
        found = letters(text[at : at + PIECE]).astype(np.uint64)
        if at + PIECE > len(text):
            found = np.append(found, np.uint64(0))
        before = np.append(carried[-1:], found[:-1])
        units = np.concatenate([carried, found[(found != 0) | (before != 0)]])
        old = len(carried)
        new = units[old:]
        any_letter = any_letter or bool(new.any())
        pairs = units[old - 1 : -1] << np.uint64(21) | new
        first = max(old, 2)
        three = units[first - 2 : -2] << np.uint64(42) | units[first - 1 : -1] << np.uint64(21) | units[first:]
        places = [new[new > 0], pairs[pairs > 0] | np.uint64(1 << 63), three[units[first - 1 : -1] > 0]]
        counts = np.bincount((mix(np.concatenate(places)) >> np.uint64(64 - bits)).astype(np.int64), minlength=size)
        total = counts if total is None else total + counts
        carried = units[-2:]
    return total if any_letter else None


class Model:
    """idf: weights of places; centroids: unit rows; of: the language of each; radius: the distance that rejects."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, of: list[str], radius: np.ndarray, bits: int):
        self.idf, self.centroids, self.of, self.radius, self.bits = idf, centroids, of, radius, bits
        self.languages = sorted(set(of))
        places = {x: k for k, x in enumerate(self.languages)}
        self.index = np.array([places[x] for x in of], dtype=np.int64)

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.sqrt(counts, dtype=np.float32) * self.idf
        n = np.linalg.norm(v)
        return v / n if n else v

    def nearer(self, text: str | None, state: tuple[str | None, float, float, float]) -> tuple[str | None, float, float, float]:
        """(language, cosine, mass, radius) of the nearest centroid, this model's or one that was found before; the mass sums
        ``exp(SHARPNESS * (cosine - 1))`` over the languages, each by its nearest centroid. No language for no letter."""
        counts = gram_counts(text, self.bits) if text else None
        if counts is None or not self.of:
            return state
        lang, cosine, mass, radius = state
        near = (self.centroids @ self.vector(counts)).astype(np.float64)
        top = np.full(len(self.languages), -1.0)
        np.maximum.at(top, self.index, near)
        mass += float(np.exp(SHARPNESS * (top - 1)).sum())
        best = int(np.argmax(near))
        if lang is None or near[best] > cosine:
            lang, cosine, radius = self.of[best], float(near[best]), float(self.radius[best])
        return lang, cosine, mass, radius


def _cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; unit centroids, without empty ones."""
    mean = vectors.mean(axis=0)
    seeds = [int(np.argmax(vectors @ mean))]
    near = vectors @ vectors[seeds[0]]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[seeds[-1]])
    centroids = vectors[seeds]
    for _ in range(rounds):
        own = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.stack([vectors[own == c].sum(axis=0) for c in range(len(centroids)) if (own == c).any()])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


_CENTROID = T.StructType([T.StructField("lang", T.StringType()), T.StructField("number", T.IntegerType()), T.StructField("centroid", T.BinaryType()), T.StructField("radius", T.DoubleType())])


def fit(docs: DataFrame, max_fit_rows: int = MAX_FIT_ROWS, clusters: int = CLUSTERS, bits: int = BITS, reject: float = REJECT) -> Model:
    """Learn a model from rows (doc_id, text, lang) that are not held out. Each language is clustered by a task of its own."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null").where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    share = rows.groupBy("lang").agg((max_fit_rows / F.count("*")).alias("share"))
    chosen = rows.join(small(durable(share)), "lang").where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_003)) < 1_000_003 * F.col("share")).select("lang", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = [], []
            for text in batch.column("text"):
                c = gram_counts(text.as_py() or "", bits)
                at = np.flatnonzero(c) if c is not None else np.zeros(0, np.int64)
                places.append(at.astype(np.int32).tobytes())
                values.append((c[at] if c is not None else at).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["lang", "places", "counts"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for at in batch.column("places").to_pylist():
                df[np.frombuffer(at, np.int32)] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["place", "n"])

    taught = durable(chosen.mapInArrow(sparse, "lang string, places binary, counts binary").where("length(places) > 0").distinct())
    n = taught.count()
    df = np.zeros(1 << bits)
    for r in taught.mapInArrow(frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        df[r["place"]] = r["n"]
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1

    def clustered(texts: pa.Table) -> pa.Table:
        own = Model(idf, np.zeros((0, 1 << bits), np.float32), [], np.zeros(0), bits)
        rows = sorted(zip(texts.column("places").to_pylist(), texts.column("counts").to_pylist(), strict=True))
        vectors = np.zeros((len(rows), 1 << bits), np.float32)
        for k, (at, c) in enumerate(rows):
            vectors[k, np.frombuffer(at, np.int32)] = np.frombuffer(c, np.int32)
            vectors[k] = own.vector(vectors[k])
        found = _cluster(vectors, clusters)
        cosine = vectors @ found.T
        radius = []
        for c in range(len(found)):
            distance = 1 - cosine[np.argmax(cosine, axis=1) == c, c]
            radius.append(float(np.quantile(distance, 1 - reject)) if len(distance) else 1.0)
        centroids = [x.astype(np.float32).tobytes() for x in found]
        return pa.table({"lang": texts.column("lang").slice(0, 1).to_pylist() * len(found), "number": pa.array(range(len(found)), pa.int32()), "centroid": pa.array(centroids, pa.binary()), "radius": pa.array(radius, pa.float64())})

    found = taught.groupBy("lang").applyInArrow(clustered, _CENTROID).orderBy("lang", "number").collect()
    centroids = np.frombuffer(b"".join(r["centroid"] for r in found), np.float32).reshape(len(found), 1 << bits)
    return Model(idf, centroids, [r["lang"] for r in found], np.array([r["radius"] for r in found]), bits)


_STATE = [("_lang", pa.string()), ("_near", pa.float64()), ("_mass", pa.float64()), ("_radius", pa.float64())]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, lang_pred, score, distance, rejected), one for each row of ``docs`` (doc_id, text).

    With more than ``LANGUAGES_A_PASS`` languages the texts pass several parts of the model, one after the other.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    texts = texts.select("doc_id", "text", F.lit(None).cast("string").alias("_lang"), F.lit(-1.0).alias("_near"), F.lit(0.0).alias("_mass"), F.lit(0.0).alias("_radius"))
    names = model.languages
    for k in range(0, len(names), LANGUAGES_A_PASS):
        own = set(names[k : k + LANGUAGES_A_PASS])
        some = np.array([x in own for x in model.of])
        part = spark.sparkContext.broadcast((model.idf, model.centroids[some], [x for x in model.of if x in own], model.radius[some], model.bits))

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            own = Model(*part.value)
            for batch in batches:
                state = [tuple(x) for x in zip(*(batch.column(n).to_pylist() for n, _ in _STATE), strict=True)]
                out = [own.nearer(t.as_py(), x) for t, x in zip(batch.column("text"), state, strict=True)]
                columns = zip(*out, strict=True) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *(pa.array(c, t) for c, (_, t) in zip(columns, _STATE, strict=True))], names=batch.schema.names)

        texts = texts.mapInArrow(run, texts.schema)
    known = F.col("_lang").isNotNull()
    distance = F.when(known, 1 - F.col("_near")).otherwise(1.0)
    score = F.when(known, F.least(F.exp(SHARPNESS * (F.col("_near") - 1)) / F.col("_mass"), F.lit(1.0))).otherwise(0.0)
    return texts.select("doc_id", F.coalesce("_lang", F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"), distance.alias("distance"), (~known | (distance > F.col("_radius"))).alias("rejected"))


def languages(docs: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, distance, rejected), one for each row of ``docs`` (doc_id, text, lang)."""
    found = predict(docs, fit(docs, **options))
    return found.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "distance", "rejected")
