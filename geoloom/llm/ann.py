"""Approximate nearest neighbours by learned partitions.

Fitting looks at a bounded sample: its exact neighbour graph is cut into balanced
parts (a start by capacity-bound centres, then moves that keep neighbours together
under the same capacity), and a small network learns to tell the part of a vector's
neighbours from the vector. Every row of the table is then filed under its most
probable part. A part of more than ``SPLIT`` rows is cut again in the same way, from
a sample of its own rows, on the executors; so the number of parts grows with the
table, up to ``MOST_PARTS`` squared. A query visits the most probable parts until
``probes`` of them, and more than k candidates, are met. ``probes`` is the smallest number
that reaches ``TARGET`` recall against brute force for held-out sample rows, at each
level, so hard data is searched wider.

Parts are searched in blocks: (part, block of candidates, chunk of queries) is one
group of bounded size, so a vector that fills a part with copies is only more
blocks. Scores are inner products of the original vectors in double precision.

Bounds (documented parameters): ``SAMPLE`` + ``HELD`` rows fit the first network and,
about, each of the second level. Every row is filed and every query searched.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do rows without a vec_id; vectors of different lengths have no
inner product, so each length is searched by itself; equal scores are ranked by
vec_id; rows that repeat a vec_id are separate candidates and separate queries, each
with ranks of its own; a query without candidates, and an empty table, give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.scratch import Scratch

#: Sample rows to fit on, and to choose ``probes`` with.
SAMPLE, HELD = 4096, 256
NEIGHBOURS, HIDDEN, EPOCHS = 10, 96, 24
TARGET = 0.96
#: Parts that one part is cut into at most, rows above which a part is cut again, rows of a part of the second level.
MOST_PARTS, SPLIT, LEAF = 256, 1 << 17, 1 << 15
#: Rows of a block of candidates, of a chunk of queries.
CANDIDATES, QUERIES = 8192, 8192
#: Scores this close to the k-th are computed again, in the same order of summation for all.
BAND = 1e-6


@dataclass
class Router:
    """Most probable parts of vectors of length one."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return self.w2.shape[1]

    def order(self, x: np.ndarray, most: int) -> np.ndarray:
        z = np.maximum(unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        return np.argmax(z, axis=1)[:, None] if most == 1 else np.argsort(-z, axis=1, kind="stable")[:, :most]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0.0), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


@dataclass
class Forest:
    """The first router, and those of the parts that are cut again; leaves are numbered through."""

    root: Router
    below: dict[int, Router] = field(default_factory=dict)

    def __post_init__(self):
        widths = [self.below[p].parts if p in self.below else 1 for p in range(self.root.parts)]
        self.first = np.append(0, np.cumsum(widths))

    @property
    def leaves(self) -> int:
        return int(self.first[-1])

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every vector."""
        part = self.root.order(x, 1)[:, 0]
        leaf = self.first[part]
        for p, router in self.below.items():
            own = np.flatnonzero(part == p)
            if len(own):
                leaf[own] += router.order(x[own], 1)[:, 0]
        return leaf

    def visit(self, x: np.ndarray, sizes: np.ndarray, k: int) -> list[list[int]]:
        """The leaves that every query visits, by the number of rows in each leaf."""
        out: list[list[int]] = [[] for _ in x]
        of_part = np.add.reduceat(sizes, self.first[:-1])
        order, visits = _until(self.root, x, of_part, k)
        asked: dict[int, list[int]] = {}
        for i, (o, v) in enumerate(zip(order, visits.tolist(), strict=True)):
            for p in o[:v].tolist():
                if p in self.below:
                    asked.setdefault(p, []).append(i)
                else:
                    out[i].append(int(self.first[p]))
        for p, rows in asked.items():
            order, visits = _until(self.below[p], x[rows], sizes[self.first[p] : self.first[p + 1]], k)
            for i, o, v in zip(rows, order, visits.tolist(), strict=True):
                out[i] += (self.first[p] + o[:v]).tolist()
        return out


def _until(router: Router, x: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts by probability, and how many of them meet ``probes`` and more than k rows."""
    order = router.order(x, len(sizes))
    return order, np.minimum(np.maximum(router.probes, (np.cumsum(sizes[order], axis=1) <= k).sum(1) + 1), len(sizes))


def _fill(gain: np.ndarray, capacity: int) -> np.ndarray:
    """A part for each row, of the best gain that has room; the most decided rows choose first."""
    n, parts = gain.shape
    taste = np.argsort(-gain, axis=1, kind="stable")
    top = np.sort(gain, axis=1)
    decided = top[:, -1] - top[:, -2] if parts > 1 else top[:, -1]
    label, room = np.zeros(n, dtype=np.int64), np.full(parts, capacity)
    for i in np.argsort(-decided, kind="stable").tolist():
        for p in taste[i].tolist():
            if room[p]:
                label[i] = p
                room[p] -= 1
                break
    return label


def cut_graph(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Balanced parts of the neighbour graph ``near``."""
    n = len(x)
    capacity = -(-n * 11 // (10 * parts)) + 1
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(rounds):
        label = _fill(x @ centres.T, capacity)
        centres = unit(np.stack([x[label == p].sum(0) if (label == p).any() else x[rng.integers(n)] for p in range(parts)]))
    here = np.repeat(np.arange(n), near.shape[1])
    for _ in range(rounds):
        count = np.zeros((n, parts))
        np.add.at(count, (here, label[near].ravel()), 1)
        np.add.at(count, (near.ravel(), label[here]), 1)
        count[np.arange(n), label] += 0.5
        label = _fill(count, capacity)
    return label


def train_router(x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """A network with one hidden layer and soft targets (Adam)."""
    n, d = x.shape
    parts = target.shape[1]
    p = [rng.normal(0, 3.0 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.05, (HIDDEN, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for a in range(0, n, 256):
            i = order[a : a + 256]
            hidden = np.maximum(x[i] @ p[0] + p[1], 0)
            z = hidden @ p[2] + p[3]
            z = np.exp(z - z.max(1, keepdims=True))
            delta = (z / z.sum(1, keepdims=True) - target[i]) / len(i)
            back = (delta @ p[2].T) * (hidden > 0)
            grads = [x[i].T @ back, back.sum(0), hidden.T @ delta, delta.sum(0)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def fit(sample: np.ndarray, parts: int, k: int, seed: int = 5) -> Router:
    """The router of a sample (rows in hash order); the last HELD rows only choose ``probes``."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    held = min(HELD, len(sample) // 4)
    raw, test = sample[: len(sample) - held], sample[len(sample) - held :]
    parts = max(1, min(parts, len(raw) // 16))
    if parts == 1:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    x = unit(raw)
    similar = x @ x.T
    np.fill_diagonal(similar, -np.inf)
    neighbours = min(NEIGHBOURS, len(x) - 1)
    near = np.argpartition(-similar, neighbours - 1, axis=1)[:, :neighbours]
    del similar
    label = cut_graph(x, near, parts, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), neighbours), label[near].ravel()), 1)
    target[np.arange(len(x)), label] += 2
    router = Router(*train_router(x, target / target.sum(1, keepdims=True), rng), parts)
    top = np.argpartition(-(test @ raw.T), min(k, len(raw)) - 1, axis=1)[:, :k]
    filed = router.order(raw, 1)[:, 0]
    visited = router.order(test, parts)
    rank = np.argsort(visited, axis=1)  # of each part, for each query
    depth = np.take_along_axis(rank, filed[top], axis=1) + 1
    router.probes = next((m for m in range(1, parts + 1) if (depth <= m).mean() >= TARGET), parts)
    return router


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


_ROW = "uid long, vec_id long, embedding array<double>"


def _filed(forest: Forest, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = forest.file(_matrix(batch.column(2), d))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(part, pa.int32())], ["uid", "vec_id", "embedding", "part"])

    return run


def _routed(forest: Forest, d: int, sizes: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = forest.visit(_matrix(batch.column(2), d), sizes, k)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(parts, pa.list_(pa.int32()))], ["query", "query_id", "embedding", "parts"])

    return run


def _cut_again(sizes: dict[int, int], d: int, k: int):
    """The router of one large part from a sample of its rows."""

    def run(rows: pa.Table) -> pa.Table:
        p = rows.column("part")[0].as_py()
        x = _matrix(rows.sort_by("uid").column("embedding"), d)
        router = fit(x[np.random.default_rng(7).permutation(len(x))], min(MOST_PARTS, -(-sizes[p] // LEAF)), k)
        return pa.Table.from_arrays([pa.array([p], pa.int32()), pa.array([pickle.dumps(router)], pa.binary())], ["part", "router"])

    return run


def best_of(queries: np.ndarray, q: np.ndarray, uids: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> tuple[list, list, list, list]:
    """The k best candidates of every query within one block: query, candidate row, candidate id, score."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    for a in range(0, len(q), 256):
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.nan_to_num(q[a : a + 256] @ c.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        other = queries[a : a + 256][:, None] != uids[None, :]
        score[~other] = -np.inf
        floor = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(score), -np.inf)
        for i in range(len(score)):
            near = floor[i] - BAND * (1 + abs(floor[i])) if np.isfinite(floor[i]) else floor[i]
            at = np.flatnonzero(other[i] & (score[i] >= near))
            with np.errstate(over="ignore", invalid="ignore"):
                exact = np.nan_to_num((c[at] * q[a + i]).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            order = np.lexsort((uids[at], ids[at], -exact))[:k]
            for have, more in zip(out, ([int(queries[a + i])] * len(order), uids[at[order]].tolist(), ids[at[order]].tolist(), exact[order].tolist()), strict=True):
                have += more
    return out


def _searched(d: int, k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: tuple[list, list, list, list] = ([], [], [], [])
        if queries.num_rows and candidates.num_rows:
            q, c = (_matrix(t.column("embedding"), d) for t in (queries, candidates))
            found = best_of(queries.column("query").to_numpy(), q, candidates.column("uid").to_numpy(), candidates.column("vec_id").to_numpy(), c, k)
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "uid", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: vec_id, embedding."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~F.coalesce(broken, F.lit(True)) & F.exists("embedding", lambda x: x != 0))


def _sampled(rows: DataFrame, share: Column) -> DataFrame:
    return rows.filter(F.pmod(F.xxhash64("uid"), F.lit(1 << 20)) < share)


def plant(rows: DataFrame, n: int, d: int, k: int, scratch: Scratch, name: str) -> tuple[Forest, DataFrame]:
    """The routers, and all rows with their leaf (written)."""
    share = F.lit(int(min(1.0, (SAMPLE + HELD) / n) * (1 << 20)) + 1)
    sample = _sampled(rows, share).orderBy(F.xxhash64("uid", F.lit(1)), "uid").limit(SAMPLE + HELD).select("embedding").toArrow()
    forest = Forest(fit(_matrix(sample.column(0), d), min(MOST_PARTS, max(2, round(n**0.5 / 8))), k))
    filed = scratch.keep(rows.mapInArrow(_filed(forest, d), f"{_ROW}, part int"), f"{name}-filed")
    large = {r["part"]: r["count"] for r in filed.groupBy("part").count().collect() if r["count"] > SPLIT}  # MOST_PARTS rows at most
    if large:
        shares = F.create_map(*(F.lit(x) for p, size in large.items() for x in (p, int((1 << 20) * min(1.0, (SAMPLE + HELD) / size)) + 1)))
        some = _sampled(filed.filter(F.col("part").isin(list(large))), shares[F.col("part")])
        routers = some.select("uid", "embedding", "part").groupBy("part").applyInArrow(_cut_again(large, d, k), "part int, router binary").collect()
        forest = Forest(forest.root, {r["part"]: pickle.loads(r["router"]) for r in routers})
        filed = scratch.keep(rows.mapInArrow(_filed(forest, d), f"{_ROW}, part int"), f"{name}-leaves")
    return forest, filed


def _of_length(rows: DataFrame, n: int, d: int, scratch: Scratch, k: int, every: int) -> DataFrame:
    """query, query_id, uid, vec_id, score: the best of each block that a query visits, among vectors of one length."""
    spark = rows.sparkSession
    forest, filed = plant(rows, n, d, k, scratch, f"d{d}")
    sizes, asked = np.zeros(forest.leaves, dtype=np.int64), np.zeros(forest.leaves, dtype=np.int64)
    for r in filed.groupBy("part").count().collect():  # leaves, MOST_PARTS squared at most
        sizes[r["part"]] = r["count"]
    routed = filed.filter(F.col("vec_id") % every == 0).select("uid", "vec_id", "embedding").mapInArrow(_routed(forest, d, sizes, k), "query long, query_id long, embedding array<double>, parts array<int>")
    routed = scratch.keep(routed, f"d{d}-routed")
    for r in routed.select(F.explode("parts").alias("part")).groupBy("part").count().collect():
        asked[r["part"]] = r["count"]
    cuts = [(p, max(1, -(-int(s) // CANDIDATES)), max(1, -(-int(a) // QUERIES))) for p, (s, a) in enumerate(zip(sizes, asked, strict=True)) if s and a]
    table = F.broadcast(spark.createDataFrame(cuts or [(-1, 1, 1)], "part int, blocks int, chunks int"))  # a row per leaf
    of = lambda count, key: F.pmod(F.xxhash64(key), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    queries = routed.select("query", "query_id", "embedding", F.explode("parts").alias("part")).join(table, "part").withColumn("chunk", of("chunks", "query")).withColumn("block", each("blocks"))
    candidates = filed.join(table, "part").withColumn("block", of("blocks", "uid")).withColumn("chunk", each("chunks"))
    keys = ["part", "block", "chunk"]
    queries, candidates = queries.select("query", "embedding", *keys).toDF("query", "embedding", *keys), candidates.select("uid", "vec_id", "embedding", *keys).toDF("uid", "vec_id", "embedding", *keys)
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(_searched(d, k), "query long, uid long, vec_id long, score double")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query order by score desc, vec_id, uid)")).filter(F.col("rank") <= k)
    return ranked.join(routed.select("query", "query_id"), "query").select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, scratch: Scratch, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``."""
    rows = scratch.keep(usable(vectors).withColumn("uid", F.monotonically_increasing_id()).select("uid", "vec_id", "embedding"), "rows")
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in sorted(rows.groupBy(F.size("embedding").alias("d")).count().collect()):  # one row per length
        out = out.unionByName(_of_length(rows.filter(F.size("embedding") == r["d"]), r["count"], r["d"], scratch, k, every))
    return out
