"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features say whether an n-gram of 3 to 5 characters occurs in the lower-cased text; n-grams are hashed to ``BUCKETS``
places. A feature's value is its naive Bayes log-count ratio between toxic and other training rows, and a logistic
regression weighs these values. The ``FEATURES`` n-grams whose ratio stands out most against its standard error are
kept, so the model has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgetrail.llm.common import runs, small_batches, smallest, texts
from lodgetrail.session import stage

ORDERS = (3, 4, 5)
BUCKETS = 1 << 20
FEATURES = 4096
#: Labelled rows the classifier is fitted on at most: those with the smallest hash of their id.
FIT_ROWS = 20_000
#: Training documents an n-gram must occur in.
LEAST_DOCUMENTS = 4
_SMOOTH = 1.0
_PAD = "\0" * (max(ORDERS) - 1)
_SLICE_CHARS = 500_000


def _ngrams(found: list[str]) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """Where each text starts and ends in one row of characters, and per order the bucket at each place of it."""
    lowered = [t.lower() for t in found]
    sizes = np.array([len(t) for t in lowered], dtype=np.int64)
    starts = np.cumsum([0, *(sizes[:-1] + len(_PAD))])
    chars = np.frombuffer((_PAD.join(lowered) + _PAD).encode("utf-32-le", "surrogatepass"), dtype="<u4")

    def buckets() -> Iterator[np.ndarray]:
        mixed = chars.copy()
        for n in range(2, max(ORDERS) + 1):
            mixed = mixed[:-1] * np.uint32(0x9E3779B1) + chars[n - 1 :]
            if n in ORDERS:
                spread = mixed ^ (mixed >> np.uint32(15))
                yield (spread * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(32 - BUCKETS.bit_length() + 1)

    return starts, starts + sizes, buckets()


def _present(found: list[str], place: np.ndarray, width: int) -> np.ndarray:
    """Which of ``width`` features occur in each text; ``place`` gives a bucket's feature or -1."""
    out = np.zeros((len(found), width), dtype=bool)
    starts, ends, orders = _ngrams(found)
    for bucket in orders:
        feature = place[bucket]
        at = np.flatnonzero(feature >= 0)
        row = np.searchsorted(starts, at, "right") - 1
        inside = at < ends[row]
        out[row[inside], feature[at[inside]]] = True
    return out


@dataclass
class ToxicityModel:
    """Buckets, their weights times ratios, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def place(self) -> np.ndarray:
        """A bucket's feature number, -1 for none."""
        place = np.full(BUCKETS, -1, dtype=np.int16)
        place[self.buckets] = np.arange(len(self.buckets))
        return place


def _place_of(buckets: np.ndarray) -> np.ndarray:
    return ToxicityModel(buckets, np.zeros(0), 0.0).place()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Fit on the labelled documents.

    ``labels`` holds ``key`` and ``label`` (1 or 0; other rows are left out). At most ``FIT_ROWS`` of them are used.
    With labels of one kind only, or none, the model has no feature and its intercept alone gives that kind's share.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_toxic"))
    known = smallest(known.where("_key IS NOT NULL AND _toxic IN (0, 1)"), F.xxhash64("_key"), ["_key", "_toxic"], FIT_ROWS)
    rows = stage(docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(known, "_key").drop("_key"), "toxicity-fit")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), dtype=np.int32)
        for batch in batches:
            found, kind = texts(batch, "text"), batch.column("_toxic").to_numpy()
            for part in runs(found, _SLICE_CHARS):
                starts, ends, orders = _ngrams(found[part])
                buckets = list(orders)
                for i, k in enumerate(kind[part]):
                    own = np.unique(np.concatenate([b[starts[i] : ends[i]] for b in buckets]))
                    seen[k, own] += 1
        held = np.flatnonzero(seen.sum(0))
        for at in range(0, len(held), 100_000):
            own = held[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(seen[1, own], pa.int64()), pa.array(seen[0, own], pa.int64())], ["bucket", "toxic", "other"])

    counts = rows.mapInArrow(count, "bucket long, toxic long, other long").groupBy("bucket").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = stage(counts, "toxicity-counts")
    total = counts.agg(F.sum(F.col("toxic") + _SMOOTH).alias("toxic"), F.sum(F.col("other") + _SMOOTH).alias("other")).first()
    kinds = {r[0]: r[1] for r in rows.groupBy("_toxic").count().collect()}
    if len(kinds) < 2:
        share = (kinds.get(1, 0) + 0.5) / (sum(kinds.values()) + 1)
        return ToxicityModel(np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    toxic, other = F.col("toxic") + _SMOOTH, F.col("other") + _SMOOTH
    ratio = F.log(toxic / F.lit(total["toxic"])) - F.log(other / F.lit(total["other"]))
    chosen = (counts.where(F.col("toxic") + F.col("other") >= LEAST_DOCUMENTS).select("bucket", ratio.alias("ratio"),
              F.abs(ratio / F.sqrt(1 / toxic + 1 / other)).alias("_z")).orderBy(F.desc("_z"), "bucket").limit(FEATURES).collect())
    if not chosen:
        share = kinds[1] / (kinds[0] + kinds[1])
        return ToxicityModel(np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    buckets = np.array([r[0] for r in chosen], dtype=np.int64)
    ratios = np.array([r[1] for r in chosen])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _place_of(buckets)
        for batch in batches:
            found = texts(batch, "text")
            bits = [b.tobytes() for part in runs(found, _SLICE_CHARS) for b in np.packbits(_present(found[part], place, len(buckets)), axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("_toxic").cast(pa.float64()), pa.array(bits, pa.binary())], ["label", "bits"])

    @F.udf(VectorUDT())
    def scaled(bits: bytes) -> SparseVector:
        on = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(ratios)))
        return SparseVector(len(ratios), on, ratios[on])

    coded = stage(rows.mapInArrow(features, "label double, bits binary"), "toxicity-features")
    model = LogisticRegression(maxIter=60, regParam=2e-4, standardization=False).fit(coded.select("label", scaled("bits").alias("features")))
    return ToxicityModel(buckets, np.array(model.coefficients.toArray()) * ratios, float(model.intercept))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "score") -> DataFrame:
    """Add ``into``: how likely each whole text is labelled toxic, from 0 to 1.

    Null and empty texts hold no n-gram and get the score of the intercept. Nothing but the text is looked at; all other
    columns pass through. One pass, no shuffle; the model's size is fixed.
    """
    small_batches(docs.sparkSession)
    buckets, weights, intercept = model.buckets, model.weights.astype(np.float64), model.intercept
    schema = docs.drop(into).withColumn(into, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _place_of(buckets)
        for batch in batches:
            found = texts(batch, text)
            sums = [_present(found[part], place, len(weights)) @ weights for part in runs(found, _SLICE_CHARS)]
            logit = np.clip((np.concatenate(sums) if sums else np.zeros(0)) + intercept, -500, 500)
            names = [f.name for f in schema]
            columns = [pa.array(1 / (1 + np.exp(-logit))) if n == into else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)
