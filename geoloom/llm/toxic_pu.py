"""Toxicity by non-negative positive-unlabelled learning (a numpy classifier).

Training sees confirmed toxic texts (P: rows labelled 1) and unlabelled text (U:
all documents outside the held-out fold, without a look at their labels). Labels of
0 are never used. The risk of a score g is ``pi*R_P(+) + max(0, R_U(-) - pi*R_P(-))``:
the class prior ``pi`` corrects for the toxic share of U, and the maximum keeps the
corrected negative risk from going below zero, which stops a flexible model
from fitting P by heart (when it falls below, the step goes back along it).

The prior is estimated from P and U alone: at the score where it is smallest, the
share of U above over the share of P above (with a margin for the size of both
samples) bounds the share of toxic texts in U.

A text is a bag of words, a word its character n-grams (hashed). Per n-gram
the documents of P and U that hold it give a shrunken log odds of being toxic;
a word has the mean odds of its strongest n-grams; a text is described by its strongest
words and its length. The odds for a training text come from the other folds of
the texts (``FOLDS`` by hash), so that no text vouches for itself. A linear model on these
features is then trained with the risk above.

Bounds (documented parameters): about ``MAX_POSITIVE`` confirmed rows at most make P,
and about ``MAX_UNLABELLED`` rows of U at most, chosen by hash, take part in the
gradient steps; the n-grams of U are counted over all its documents. The n-gram
table has ``TABLE`` entries. Scoring covers every whole text.

Defined cases: null and empty texts get the score of a text without words;
labels that are null or repeat count once, the larger one; with no toxic
training row every score is 0; an empty table gives no rows; a null doc_id is
outside the held-out fold; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm import textscan as ts
from geoloom.llm.pack import Memo

MAX_POSITIVE, MAX_UNLABELLED = 16_384, 16_384
TABLE_BITS = 20
TABLE = 1 << TABLE_BITS
GRAMS = (3, 4, 5, 6)
THRESHOLD = 0.3
#: Words (below ``ts.LONG`` bytes) that a worker remembers before it starts anew.
MEMO = 1 << 18
#: Words whose n-grams are held at once.
AT_ONCE = 1 << 12
#: Parts of the training texts; a text is described by the odds of the others.
FOLDS = 4
#: Confirmed documents from which on an n-gram has odds of its own.
LEAST = 2
_FOLD_SEED = 11


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never looked at in training."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def word_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table entries, word of each entry) of the n-grams of words, with marks at both ends, and of the words themselves."""
    lengths = (ends - starts + 2).astype(np.int64)
    stops = np.cumsum(lengths)
    begins = stops - lengths
    total = int(stops[-1]) if len(stops) else 0
    inner = np.arange(total) - np.repeat(begins, lengths)
    src = np.repeat(starts, lengths) + inner - 1
    text = np.where(inner == 0, np.uint8(2), np.where(inner == np.repeat(lengths, lengths) - 1, np.uint8(3), data[np.clip(src, 0, max(len(data) - 1, 0))] if len(data) else np.uint8(0)))
    out, words = [ts.hashes(text, begins, stops)], [np.arange(len(starts))]
    owner = np.repeat(np.arange(len(starts)), lengths)
    left = np.repeat(stops, lengths) - np.arange(total)
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        out.append(ts.hashes(text, at, at + n))
        words.append(owner[at])
    return (np.concatenate(out) >> np.uint64(64 - TABLE_BITS)).astype(np.int64), np.concatenate(words)


def _words(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, the word spans, the first word of each document."""
    low = ts.LOWER[data]
    return low, *ts.spans(low, offsets, ts.ALNUM)


def _count(wanted):
    """Per fold, the number of documents that hold each n-gram (of those ``wanted``, a broadcast table of booleans), and of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = wanted.value if wanted else None

        def entries(words: list[bytes]) -> list[np.ndarray]:
            out: list[np.ndarray] = []
            for a in range(0, len(words), AT_ONCE):
                part = words[a : a + AT_ONCE]
                stops = np.cumsum([len(w) for w in part])
                grams, word = word_grams(np.frombuffer(b"".join(part), dtype=np.uint8), stops - [len(w) for w in part], stops)
                if mask is not None:
                    grams, word = grams[mask[grams]], word[mask[grams]]
                order = np.argsort(word, kind="stable")
                out += np.split(grams[order].astype(np.int32), np.searchsorted(word[order], np.arange(1, len(part))))
            return out

        memo = Memo(entries, MEMO, 1 << 23, 1 << 22)
        counts, docs = np.zeros((FOLDS, TABLE), dtype=np.int32), [0] * FOLDS
        for batch in batches:
            folds = batch.column(0).to_pylist()
            for a, _, data, offsets in ts.slices(batch.column(1)):
                low, starts, ends, first = _words(data, offsets)
                where, which = ts.distinct(low, starts, ends)
                raw = low.tobytes()
                slot = memo.slots([raw[i:j] for i, j in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])[which]
                for d in range(len(offsets) - 1):
                    docs[folds[a + d]] += 1
                    grams, _ = memo.gather(np.unique(slot[first[d] : first[d + 1]]))
                    counts[folds[a + d]][grams] += 1  # once, however often the document holds it
        for fold in range(FOLDS):
            at = np.flatnonzero(counts[fold])
            n = len(at) + 1
            yield pa.RecordBatch.from_arrays([pa.array([fold] * n, pa.int32()), pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(counts[fold][at].astype(np.int64), docs[fold]), pa.int64())], ["fold", "gram", "docs"])

    return run


def counted(rows: DataFrame, wanted=None) -> tuple[np.ndarray, np.ndarray]:
    """Documents by fold and n-gram, and by fold, of (fold, text) rows; FOLDS * TABLE counts at most come to the driver."""
    found = rows.select("fold", "text").mapInArrow(_count(wanted), "fold int, gram long, docs long").groupBy("fold", "gram").agg(F.sum("docs").alias("docs")).toArrow()
    table, totals = np.zeros((FOLDS, TABLE)), np.zeros(FOLDS)
    fold, gram, docs = (found.column(c).to_numpy() for c in ("fold", "gram", "docs"))
    real = gram >= 0
    table[fold[real], gram[real]] = docs[real]
    totals[fold[~real]] = docs[~real]
    return table, totals


def log_odds(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """Shrunken log odds of toxic per n-gram: Pr(toxic | gram) is ``prior`` times the ratio of its shares in P and U."""
    share_p, share_u = p / max(n_p, 1), u / max(n_u, 1)
    weak = 3.0 / max(n_p, 1)
    toxic = prior * np.maximum(share_p - np.sqrt(share_p / max(n_p, 1)), 0.0)
    clean = np.maximum(share_u - prior * share_p, 0.0) + np.sqrt(np.maximum(share_u, 0.0) / max(n_u, 1)) * 0.5 + prior * weak * 0.25
    return np.where(p >= LEAST, np.log(toxic + 1e-9) - np.log(clean), -12.0).clip(-8.0, 8.0)


FEATURES = 6
#: A word is as toxic as the mean of its so many strongest n-grams.
STRONGEST = 5


def word_odds(odds: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Mean of the strongest odds of each word; one stray n-gram does not convict a word."""
    order = np.lexsort((-odds, word))
    odds, word = odds[order], word[order]
    first = np.searchsorted(word, np.arange(n))
    last = np.searchsorted(word, np.arange(n), side="right") - 1
    return np.mean([odds[np.minimum(first + k, last)] for k in range(STRONGEST)], axis=0)


def describe(data: np.ndarray, offsets: np.ndarray, odds: np.ndarray, memo: dict[bytes, float]) -> np.ndarray:
    """One row of features per document: strongest word, odds above three levels, mean of the strongest, length."""
    low, starts, ends, first = _words(data, offsets)
    out = np.zeros((len(offsets) - 1, FEATURES))
    out[:, 0] = -8.0
    if not len(starts):
        return out
    where, which = ts.distinct(low, starts, ends)
    if len(memo) > MEMO:
        memo.clear()
    get, raw = memo.get, low.tobytes()
    own = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
    value = np.array([get(x, np.nan) for x in own])
    new = np.flatnonzero(np.isnan(value))
    for a in range(0, len(new), AT_ONCE):
        part = new[a : a + AT_ONCE]
        grams, word = word_grams(low, starts[where[part]], ends[where[part]])
        best = word_odds(odds[grams], word, len(part))
        value[part] = best
        memo.update((own[i], x) for i, x in zip(part.tolist(), best.tolist(), strict=True) if len(own[i]) < ts.LONG)
    v = value[which]
    n = first[1:] - first[:-1]
    out[:, 0] = ts.by_document(v, first, np.maximum, -8.0)
    for k, level in enumerate((0.0, 1.5, 3.0)):
        out[:, 1 + k] = np.log1p(ts.by_document((v > level).astype(np.float64), first, np.add, 0.0))
    out[:, 4] = np.log1p(n)
    out[:, 5] = np.log1p(1000.0 * ts.by_document(np.maximum(v, 0.0), first, np.add, 0.0) / np.maximum(n, 1))
    return out


def _described(shared):
    """Features of the training rows, by the odds of the other folds (broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = shared.value
        memos: list[dict[bytes, float]] = [{} for _ in odds]
        for batch in batches:
            folds = np.array(batch.column(1).to_pylist())
            rows = np.zeros((batch.num_rows, FEATURES))
            for fold, table in enumerate(odds):
                own = np.flatnonzero(folds == fold)
                for a, b, data, offsets in ts.slices(batch.column(2).take(pa.array(own))):
                    rows[own[a:b]] = describe(data, offsets, table, memos[fold])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), *(pa.array(rows[:, k]) for k in range(FEATURES))], ["kind", *(f"x{k}" for k in range(FEATURES))])

    return run


@dataclass
class ToxicModel:
    """Odds of the n-grams and the linear model on the features of a text."""

    odds: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    empty: bool = False
    prior: float = 0.0

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.empty:
            return np.zeros(len(features))
        # The risk's own decision, a margin of 0, gets the score THRESHOLD.
        return 1.0 / (1.0 + np.exp(-np.clip((features - self.mean) / self.scale @ self.weights + self.bias + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def nn_pu_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, flag: float = 0.5, steps: int = 1200, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk (Adam, full batches).

    The first fold of the steps has the logistic loss, which is convex and finds
    the direction; the second fold has the sigmoid loss, which is bounded, so that
    a small error of the prior does not weigh more the surer the model gets. To
    flag a clean text costs ``flag``, to miss a toxic one ``1 - flag``.
    """
    xp, xu = np.hstack([positive, np.ones((len(positive), 1))]), np.hstack([unlabelled, np.ones((len(unlabelled), 1))])
    theta = np.zeros(xp.shape[1])
    for bounded in (False, True):
        m, v = np.zeros(len(theta)), np.zeros(len(theta))
        for t in range(1, steps // 2 + 1):
            gp, gu = np.clip(xp @ theta, -30, 30), np.clip(xu @ theta, -30, 30)
            sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
            if bounded:
                miss = clean_p = (sp * (1 - sp)) @ xp / len(xp)
                clean_u = (su * (1 - su)) @ xu / len(xu)
                risk = su.mean() - prior * sp.mean()
            else:
                miss, clean_p, clean_u = (1 - sp) @ xp / len(xp), sp @ xp / len(xp), su @ xu / len(xu)
                risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            clean = clean_u - prior * clean_p
            grad = (flag * clean - (1 - flag) * prior * miss if risk >= 0 else -flag * clean) + decay * np.append(theta[:-1], 0.0)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta - rate * (1 - 0.9 * t / (steps // 2)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float, doubt: float = 0.1) -> float:
    """The share of toxic texts in U from scores of P and U: their shares above the cut at which the bound is tightest."""
    cuts = np.unique(positive)
    above_p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    slack = sum(np.sqrt(np.log(4 / doubt) / (2 * len(x))) for x in (positive, unlabelled))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], least, 0.9))


def training_rows(documents: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> tuple[DataFrame, DataFrame]:
    """(kind, fold, text) of P (kind 0) and of the rows of U that take gradient steps (kind 1), and (fold, text) of all of U."""
    confirmed = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("label_id")) & (F.col("toxic") == 1)).select("label_id")
    within = lambda key, limit, of: F.pmod(F.xxhash64(key, F.lit(_FOLD_SEED)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, limit / max(of, 1)))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(_FOLD_SEED + 1)), F.lit(FOLDS)).cast("int").alias("fold")
    open_ = documents.select("doc_id", F.col("text").cast("string").alias("text")).filter(~held_out(F.col("doc_id")))
    # About max_positive ids at most, hence the broadcast.
    ids = F.broadcast(confirmed.filter(within("label_id", max_positive, confirmed.count())))
    p = open_.join(ids, F.col("doc_id") == F.col("label_id"), "left_semi").select(F.lit(0).alias("kind"), fold, "text")
    u = open_.filter(within("doc_id", max_unlabelled, open_.count())).select(F.lit(1).alias("kind"), fold, "text")
    return p.unionByName(u), open_.select(fold, "text")


def fit(documents: DataFrame, labels: DataFrame, scratch, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> ToxicModel:
    """Counts run on the executors; what comes to the driver is bounded by TABLE and by the two row bounds."""
    context = documents.sparkSession.sparkContext
    rows, whole = training_rows(documents, labels, max_positive, max_unlabelled)
    rows = scratch.keep(rows, "training")
    none = np.zeros(FEATURES)
    p, n_p = counted(rows.filter("kind = 0"))
    if not n_p.sum():
        return ToxicModel(np.zeros(TABLE, dtype=np.float32), none, none + 1, none, 0.0, empty=True)
    # log_odds gives n-grams with fewer than LEAST confirmed documents its lowest value, whatever U holds.
    u, n_u = counted(whole, context.broadcast(p.sum(0) >= LEAST))

    def frame(prior: float) -> tuple[np.ndarray, np.ndarray]:
        """Features of the training rows, each by the odds of the other folds, and which of them are P."""
        others = [[x for x in range(FOLDS) if x != h] for h in range(FOLDS)]
        odds = [log_odds(p[o].sum(0), u[o].sum(0), n_p[o].sum(), n_u[o].sum(), prior).astype(np.float32) for o in others]
        found = rows.mapInArrow(_described(context.broadcast(odds)), "kind int, " + ", ".join(f"x{k} double" for k in range(FEATURES))).toArrow()
        return np.column_stack([found.column(f"x{k}").to_numpy() for k in range(FEATURES)]), found.column("kind").to_numpy() == 0

    least = n_p.sum() / n_u.sum()  # P is part of U
    x, is_p = frame(least)
    mean, scale = x[~is_p].mean(0), x[~is_p].std(0) + 1e-6
    weights, _ = nn_pu_fit((x[is_p] - mean) / scale, (x[~is_p] - mean) / scale, least)
    prior = class_prior(x[is_p] / scale @ weights, x[~is_p] / scale @ weights, least)
    x, is_p = frame(prior)
    mean, scale = x[~is_p].mean(0), x[~is_p].std(0) + 1e-6
    weights, bias = nn_pu_fit((x[is_p] - mean) / scale, (x[~is_p] - mean) / scale, prior, THRESHOLD)
    odds = log_odds(p.sum(0), u.sum(0), n_p.sum(), n_u.sum(), prior).astype(np.float32)
    return ToxicModel(odds, mean, scale, weights, bias, prior=prior)


_WORKER: dict = {}


def scores(documents: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id and score of every row."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # TABLE floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if _WORKER.get("of") is not m:
            _WORKER.update(of=m, memo={})
        memo = _WORKER["memo"]
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, data, offsets in ts.slices(batch.column(1)):
                out[a:b] = m.score(describe(data, offsets, m.odds, memo))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out)], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(documents: DataFrame, labels: DataFrame, scratch, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold, with all their columns and without a shuffle.

    Null and empty texts are judged as a text without words, repeated rows alike;
    without toxic training rows all stay; an empty table stays empty.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, scratch))
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        memo: dict[bytes, float] = {}
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, data, offsets in ts.slices(batch.column(text)):
                out[a:b] = m.score(describe(data, offsets, m.odds, memo))
            yield batch.filter(pa.array(out < threshold))

    return documents.mapInArrow(run, documents.schema)


def toxicity(documents: DataFrame, labels: DataFrame, scratch) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = scores(documents, fit(documents, labels, scratch))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
