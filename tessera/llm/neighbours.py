"""Approximate nearest neighbours by learned partitions.

On a sample of at most SAMPLE vectors the graph of nearest neighbours is built and cut into balanced parts, so that neighbours
mostly share a part. A small classifier, a softmax regression, learns the part from the vector. It deals every vector of the whole table to its most
probable part and sends every query to its most probable parts, as many as the sample's own queries need to find
RECALL of their neighbours. There the query is compared with all vectors of the part in double precision.

Equal vectors differ in nothing but their ids, so of each group only as many of the smallest different ids can be in a result as are asked
for and one more: each task keeps no more of them, and so a vector that a third of all rows share is no hot spot. Parts
of many vectors are searched in blocks. Both prunings are exact.

Defined cases: vectors that are null, empty or zero, that hold null or non-finite numbers or have not the most frequent
length, and rows with null ids take no part; ties go to the smaller id; with fewer candidates than asked for, all are returned; a table
without vectors gives no rows. An id is one query and one neighbour, however many rows have it: the query is the smallest of its vectors, the
neighbour is as near as the nearest of them, and no id is a neighbour of its own. Columns besides the id and the vector are left alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import hash_sample, map_arrow, materialise, ship

#: Vectors from which the partitions are learned, at most.
SAMPLE = 8192
#: Neighbours of a vector in the graph, and the share of them that the sample's queries must find.
GRAPH, RECALL = 10, 0.97
#: Vectors of a part of the sample, and parts at most.
PART, MOST_PARTS = 192, 64
#: Vectors of a block of a part.
BLOCK = 4096


def nearest(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of the k nearest vectors of each query, unordered; about, by the expanded square."""
    d = (queries**2).sum(1)[:, None] - 2 * queries @ vectors.T + (vectors**2).sum(1)
    k = min(k, len(vectors))
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    return at, np.take_along_axis(d, at, 1)


def graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each vector."""
    out = np.empty((len(vectors), min(k, len(vectors) - 1)), np.int64)
    for a in range(0, len(vectors), 512):
        at, d = nearest(vectors[a : a + 512], vectors, k + 1)
        at = np.take_along_axis(at, np.argsort(d, axis=1, kind="stable"), 1)
        for r, row in enumerate(at):
            others = row[row != a + r]
            out[a + r] = others[: out.shape[1]]
    return out


def balanced_parts(vectors: np.ndarray, edges: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """A part for each vector. Parts are grown by halving along the widest direction, then vectors move to the part that holds most of
    their graph neighbours as long as no part grows beyond a tenth over its share."""
    part = np.zeros(len(vectors), np.int64)
    have = 1
    while have < parts:
        sizes = np.bincount(part, minlength=have)
        big = int(sizes.argmax())
        mine = np.flatnonzero(part == big)
        centred = vectors[mine] - vectors[mine].mean(0)
        direction = rng.normal(size=vectors.shape[1])
        for _ in range(8):
            direction = centred.T @ (centred @ direction)
            direction /= np.linalg.norm(direction) + 1e-30
        order = np.argsort(centred @ direction, kind="stable")
        part[mine[order[len(order) // 2 :]]] = have
        have += 1
    both = [[] for _ in range(len(vectors))]
    for i, row in enumerate(edges):
        for j in row:
            both[i].append(int(j))
            both[int(j)].append(i)
    most = int(np.ceil(1.1 * len(vectors) / parts))
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(vectors)):
            votes = np.bincount(part[both[i]], minlength=parts) if both[i] else np.zeros(parts, int)
            votes[sizes >= most] = 0
            best, own = int(votes.argmax()), part[i]
            if votes[best] > np.count_nonzero(part[both[i]] == own):
                sizes[own] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if moved < len(vectors) // 200:
            break
    return part


@dataclass
class PartitionModel:
    """A softmax regression on vectors of length one. probes: parts to which a query goes."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        return unit @ self.weights + self.bias

    def own(self, vectors: np.ndarray) -> np.ndarray:
        return self.logits(vectors).argmax(1)

    def probed(self, vectors: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(vectors), axis=1, kind="stable")[:, : self.probes]


def fit_partitions(sample: np.ndarray, seed: int = 1, epochs: int = 60) -> PartitionModel:
    """Learn from a sample; the number of probes is the smallest that finds RECALL of the sample's graph."""
    rng = np.random.default_rng(seed)
    parts = int(min(MOST_PARTS, max(1, len(sample) // PART)))
    dim = sample.shape[1]
    model = PartitionModel(np.zeros((dim, parts)), np.zeros(parts), 1)
    if parts == 1:
        return model
    edges = graph(sample, GRAPH)
    part = balanced_parts(sample, edges, parts, rng)
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    target = np.zeros((len(sample), parts))
    target[np.arange(len(sample)), part] = 1
    moment, second, step = [np.zeros_like(model.weights), np.zeros_like(model.bias)], [np.zeros_like(model.weights), np.zeros_like(model.bias)], 0
    for _ in range(epochs):
        order = rng.permutation(len(sample))
        for a in range(0, len(order), 256):
            x, y = unit[order[a : a + 256]], target[order[a : a + 256]]
            z = x @ model.weights + model.bias
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - y) / len(x)
            step += 1
            for k, (value, slope) in enumerate(((model.weights, x.T @ g + 1e-5 * model.weights), (model.bias, g.sum(0)))):
                moment[k] = 0.9 * moment[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                value -= 0.05 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    own = model.own(sample)
    ranks = np.argsort(np.argsort(-model.logits(sample), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.take_along_axis(ranks, own[edges], 1).ravel()
    model.probes = int(np.quantile(needed, RECALL, method="higher")) + 1
    return model


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where("vec_id is not null and size(vector) > 0")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _rows(kind: int, part: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(part.astype(np.int32)), pa.array(ids), lists], names=["kind", "part", "vec_id", "vector"])


def _asked(model):
    """Rows (1, part, vec_id, vector): each query once for each part to which it goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            if len(ids):
                probed = model.value.probed(vectors)
                yield _rows(1, probed.ravel(), np.repeat(ids, probed.shape[1]), np.repeat(vectors, probed.shape[1], axis=0))

    return run


def _dealt(model, k: int, dim: int):
    """Rows (0, part, vec_id, vector) of candidates. Of equal vectors the k + 1 smallest different ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            ids = np.array([i for x in kept.values() for i in x], np.int64)
            vectors = np.repeat(np.frombuffer(b"".join(kept), np.float64).reshape(-1, dim), [len(x) for x in kept.values()], axis=0)
            return _rows(0, model.value.own(vectors), ids, vectors)

        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), np.ascontiguousarray(_matrix(batch.column(1)))
            for i, v in zip(ids.tolist(), vectors + 0.0, strict=True):
                same = kept.setdefault(v.tobytes(), [])
                if i in same:
                    continue
                if len(same) <= k:
                    same.append(i)
                elif i < (most := max(same)):
                    same[same.index(most)] = i
            if len(kept) >= 1 << 16:
                yield flush()
                kept = {}
        if kept:
            yield flush()

    return run


def nearest_ids(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest different ids, nearest first, ties to the smaller id; of an id its nearest place."""
    order = np.lexsort((ids, scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def _searched(k: int):
    """Partitions come sorted by part, block and kind, queries first. Rows (query_id, vec_id, score): the k nearest of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, candidates = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if not queries or not candidates:
                return
            qi, qv = np.concatenate([x for x, _ in queries]), np.concatenate([x for _, x in queries])
            ci, cv = np.concatenate([x for x, _ in candidates]), np.concatenate([x for _, x in candidates])
            for a in range(0, len(qi), 256):
                at, rough = nearest(qv[a : a + 256], cv, 2 * k + 12)
                out = []
                for r in range(len(at)):
                    # exactly, among all whose rough distance may be one of the k smallest
                    own, v = qi[a + r], qv[a + r]
                    worst = np.partition(rough[r], min(k, len(rough[r]) - 1))[min(k, len(rough[r]) - 1)]
                    slack = 1e-9 * (1.0 + (v**2).sum() + (cv**2).sum(1).max())
                    near = at[r]
                    if len(near) < len(ci) and rough[r].max() <= worst + slack:
                        d = (v**2).sum() - 2 * cv @ v + (cv**2).sum(1)
                        near = np.flatnonzero(d <= worst + slack)
                    near = near[ci[near] != own]
                    score = np.sqrt(((cv[near] - v) ** 2).sum(1))
                    order = nearest_ids(ci[near], score, k)
                    if len(order) < k and len(near) < len(ci):  # rows of few ids are in the way of the others
                        near = np.flatnonzero(ci != own)
                        score = np.sqrt(((cv[near] - v) ** 2).sum(1))
                        order = nearest_ids(ci[near], score, k)
                    out.append((np.full(len(order), own), ci[near][order], score[order]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            part, block, kind, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            vectors = _matrix(batch.column(4))
            turns = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(part)], strict=True):
                if a == b:
                    continue
                if key != (part[a], block[a]):
                    yield from flush()
                    key, queries, candidates = (part[a], block[a]), [], []
                (queries if kind[a] else candidates).append((ids[a:b], vectors[a:b]))
        yield from flush()

    return run


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", sample_size: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the k nearest other rows found, by
    Euclidean distance. The partitions are learned from at most ``sample_size`` vectors; all vectors are dealt to them."""
    spark = vectors.sparkSession
    ship(spark)
    usable = _usable(vectors, id_col, vector_col)
    length = usable.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = length["n"]
    usable = usable.where(F.size("vector") == dim)
    # the bounded sample is of different vectors, those with the smallest hashes
    kinds = usable.select(F.xxhash64("vector").alias("h"), "vector")
    kinds = kinds.groupBy("h").agg(F.first("vector").alias("vector"))
    different = {r["h"]: r["vector"] for r in hash_sample(kinds, "h", sample_size).collect()}
    model = spark.sparkContext.broadcast(fit_partitions(np.array([different[h] for h in sorted(different)])))
    queries = usable.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    shape = "kind int, part int, vec_id long, vector array<double>"
    dealt = materialise(usable.transform(map_arrow, _dealt(model, k, dim), shape).unionByName(queries.transform(map_arrow, _asked(model), shape)), "dealt")
    # a row for each part
    sizes = dealt.where("kind = 0").groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = dealt.join(F.broadcast(sizes), "part")
    block = F.when(F.col("kind") == 0, F.array(F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("block", F.explode(block)).select("part", "block", "kind", "vec_id", "vector")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(n, "part", "block").sortWithinPartitions("part", "block", F.desc("kind")).transform(map_arrow, _searched(k), "query_id long, vec_id long, score double")
    # a query has k rows from each block that it visited; an id may be in several
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("place", "b")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
