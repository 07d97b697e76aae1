"""Quality by importance resampling: two hashed n-gram models and Gumbel top-k.

A text is a stream of tokens (runs of letters and digits, runs of other
signs). Every token stands for itself and for its shape (case, kind of sign,
whether it repeats the token before); the features are the hashed n-grams of
both streams (tokens up to pairs, shapes up to triples), ``BUCKETS`` of them. The target model counts the features of the rows
labelled good, at most ``MAX_TARGET`` of them, the raw model those of all rows. The log weight of a text is the
sum of its features' log ratios, as in importance sampling from raw to target.

Sampling without replacement in proportion to the weights is a top-k of the log
weight plus Gumbel noise (from a hash of the row, so that a repeated task draws
the same). As in published importance resampling the log weight of a text is a sum
over all its features and the noise has the scale 1 (``temperature``), so chance
decides between texts of similar weight only. The k-th key is found by narrowing a histogram of the keys, never by
sorting all rows in one task.

k is the number of rows whose log weight reaches ``cut``, which is where the labelled
rows (training fold only) are told apart best.

Bounds (documented parameters, about as many rows by hash): at most ``MAX_TARGET``
good rows are counted for the target model, and the cut is placed on at most
``MAX_CALIBRATION`` labelled rows. Weights and keys cover every row.

Defined cases: null and empty texts have no features and log weight 0; rows
that repeat draw the same noise; ties at the k-th key are all taken; labels
that are null are ignored and of repeated ones the largest counts; without good labels all rows are
taken; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import textscan as ts
from geoloom.llm.scratch import Scratch, free_name

BUCKETS = 1 << 16
#: Labelled good rows to count at most for the target model, chosen by hash.
MAX_TARGET = 1 << 16
#: Labelled rows to place the cut with.
MAX_CALIBRATION = 1 << 14
SEED = 77
BINS = 1 << 12

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 1, 2, 3, 1
_KIND[(_KIND == 0) & ts.NOT_SPACE] = 4


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every feature, first feature of each document)."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    word = _KIND[data]
    alnum = (word > 0) & (word < 4)
    starts_a, ends_a, _ = ts.spans(data, offsets, (_KIND > 0) & (_KIND < 4))
    starts_p, ends_p, _ = ts.spans(data, offsets, _KIND == 4)
    starts = np.concatenate([starts_a, starts_p])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.concatenate([ends_a, ends_p])[order]
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.int64), first
    itself = ts.hashes(data, starts, ends)
    upper = np.append(0, np.cumsum(word == 2))
    digit = np.append(0, np.cumsum(word == 3))
    length = ends - starts
    ups, digs = upper[ends] - upper[starts], digit[ends] - digit[starts]
    sign = ~alnum[starts]
    shape = np.select([sign & (length == 1), sign, digs == length, digs > 0, (ups == length) & (length > 1), ups == 1, ups > 1], [data[starts].astype(np.int64) + 10, data[starts].astype(np.int64) + 300, 1, 2, 3, 4, 5], 6)
    same = np.zeros(len(starts), dtype=bool)
    same[1:] = itself[1:] == itself[:-1]
    same[first[:-1][first[:-1] < first[1:]]] = False  # the document before is no context
    shape = (shape * 2 + same).astype(np.uint64)
    shape = ts.mix(shape * np.uint64(0x9E3779B97F4A7C15))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out, owner = [itself, shape], [doc, doc]
    for stream, n in ((itself, 2), (shape, 2), (shape, 3)):
        if len(stream) >= n:
            inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
            out.append(ts.chained(stream, n)[inside])
            owner.append(doc[: len(doc) - n + 1][inside])
    own = np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return (np.concatenate(out)[order] % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(own[order], np.arange(len(first)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature counts of a partition's raw rows (kind 0) and of its target rows (kind 1)."""
    counts = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        target = np.array(batch.column(0).to_pylist(), dtype=bool)
        for a, b, data, offsets in ts.slices(batch.column(1)):
            f, first = features(data, offsets)
            counts[0] += np.bincount(f, minlength=BUCKETS)
            if target[a:b].any():
                counts[1] += np.bincount(f[np.repeat(target[a:b], np.diff(first))], minlength=BUCKETS)
    for kind in (0, 1):
        if counts[kind].any():
            at = np.flatnonzero(counts[kind])
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(counts[kind][at], pa.int64())], ["kind", "bucket", "n"])


@dataclass
class Ratio:
    """Log ratio of target to raw by feature bucket."""

    ratio: np.ndarray | None


def fit_ratio(documents: DataFrame, good: DataFrame) -> Ratio:
    """``good``: (good_id) of the target rows, about MAX_TARGET ids at most, hence the broadcast.

    Counts cover all rows; BUCKETS counts per model come to the driver.
    """
    marked = documents.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left")
    counted = marked.select(F.col("good_id").isNotNull().alias("target"), "text").mapInArrow(_count, "kind int, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((2, BUCKETS))
    table[counted.column("kind").to_numpy(), counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    if not table[1].any():
        return Ratio(None)
    raw, target = ((table[k] + 0.5) / (table[k].sum() + 0.5 * BUCKETS) for k in (0, 1))
    return Ratio(np.log(target) - np.log(raw))


def _keys(column: pa.Array, uniform: pa.Array, ratio: np.ndarray | None, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    """Log weight and Gumbel key of every text of a batch."""
    weight = np.zeros(len(column))
    for a, b, data, offsets in ts.slices(column) if ratio is not None else ():
        f, first = features(data, offsets)
        weight[a:b] = ts.by_document(ratio[f], first, np.add, 0.0)
    return weight, weight - temperature * np.log(-np.log(uniform.to_numpy(zero_copy_only=False)))


def _uniform(seed: int):
    """In (0, 1), from a hash of the row's id and text length: the same on every run."""
    return (F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def gumbel_keys(documents: DataFrame, ratio: Ratio, seed: int = SEED, temperature: float = 1.0) -> DataFrame:
    """doc_id, log_weight, gumbel_key of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(ratio.ratio)  # BUCKETS floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, key = _keys(batch.column(1), batch.column(2), shared.value, temperature)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(weight), pa.array(key)], ["doc_id", "log_weight", "gumbel_key"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _uniform(seed).alias("u")).mapInArrow(run, "doc_id long, log_weight double, gumbel_key double")


def take_from(documents: DataFrame, ratio: Ratio, least: float, seed: int = SEED, temperature: float = 1.0) -> DataFrame:
    """The rows of which ``gumbel_keys`` gives ``least`` or more, with all their columns and without a shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(ratio.ratio)
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            _, key = _keys(batch.column(text), batch.column(n), shared.value, temperature)
            yield batch.select(list(range(n))).filter(pa.array(key >= least))

    return documents.select("*", _uniform(seed).alias(free_name(documents, "u"))).mapInArrow(run, documents.schema)


def best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """The log weight at or above which rows are taken: fewest labelled rows on the wrong side, the widest gap's middle on ties."""
    if not len(weight) or good.all() or not good.any():
        return float("-inf")
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    wrong = np.append(0, np.cumsum(g)) + ((~g).sum() - np.append(0, np.cumsum(~g)))
    best = np.flatnonzero(wrong == wrong.min())
    edge = np.concatenate([[w[0] - 1], w, [w[-1] + 1]])
    k = best[np.argmax(edge[best + 1] - edge[best])]
    return float((edge[k] + edge[k + 1]) / 2)


def kth_largest(keyed: DataFrame, key: str, k: int) -> float:
    """The k-th largest key, exactly and without a global sort: each pass counts BINS ranges and looks into one of them."""
    if k <= 0:
        return float("inf")
    low, high, n = keyed.agg(F.min(key), F.max(key), F.count(key)).first()
    if n <= k:
        return float("-inf")
    while low < high:
        step = (high - low) / BINS
        bin_ = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(step)), F.lit(BINS - 1)) if low + step > low else F.col(key)
        ranges = keyed.filter((F.col(key) >= low) & (F.col(key) <= high)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        for r in sorted(ranges.collect(), key=lambda r: -r["low"]):
            if r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def training_labels(labels: DataFrame) -> DataFrame:
    """label_id and quality of the fold that may be learned from."""
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))
    return labels.filter(fold).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality")).filter("quality is not null")


def some(rows: DataFrame, limit: int, of: int, seed: int) -> DataFrame:
    """About ``limit`` of the ``of`` rows, by hash of label_id."""
    return rows if of <= limit else rows.filter(F.pmod(F.xxhash64("label_id", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * limit / of))


def fit_and_key(documents: DataFrame, labels: DataFrame, scratch: Scratch, seed: int = SEED, temperature: float = 1.0, max_target: int = MAX_TARGET, max_calibration: int = MAX_CALIBRATION) -> tuple[DataFrame, Ratio, float]:
    """The keys of all rows (written), the models' ratio, and the smallest key that is taken.

    About ``max_target`` good rows at most make the target model, and ``max_calibration`` labelled rows at most place the cut.
    """
    known = scratch.keep(training_labels(labels), "labels")
    n, n_good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    ratio = fit_ratio(documents, some(known.filter("quality = 1"), max_target, n_good, seed).select(F.col("label_id").alias("good_id")))
    keyed = scratch.keep(gumbel_keys(documents, ratio, seed, temperature), "keys")
    if ratio.ratio is None:
        return keyed, ratio, float("-inf")
    tried = keyed.join(some(known, max_calibration, n, seed + 1), F.col("doc_id") == F.col("label_id")).select("log_weight", "quality").toArrow()
    cut = best_cut(tried.column("log_weight").to_numpy(), tried.column("quality").to_numpy() == 1)
    return keyed, ratio, kth_largest(keyed, "gumbel_key", keyed.filter(F.col("log_weight") >= F.lit(cut)).count())


def importance_resample(documents: DataFrame, labels: DataFrame, scratch: Scratch, seed: int = SEED, temperature: float = 1.0, max_target: int = MAX_TARGET, max_calibration: int = MAX_CALIBRATION) -> DataFrame:
    """doc_id, log_weight, gumbel_key, selected of every row."""
    keyed, _, least = fit_and_key(documents, labels, scratch, seed, temperature, max_target, max_calibration)
    return keyed.select("doc_id", "log_weight", "gumbel_key", (F.col("gumbel_key") >= F.lit(least)).alias("selected"))


def drop_unselected(documents: DataFrame, labels: DataFrame, scratch: Scratch, seed: int = SEED, temperature: float = 1.0, max_target: int = MAX_TARGET, max_calibration: int = MAX_CALIBRATION) -> DataFrame:
    """The documents that resampling selects; all columns stay.

    Null and empty texts have log weight 0; rows that repeat id and text share
    their fate; without good labels all rows stay; an empty table stays empty.
    """
    _, ratio, least = fit_and_key(documents, labels, scratch, seed, temperature, max_target, max_calibration)
    return take_from(documents, ratio, least, seed, temperature)
