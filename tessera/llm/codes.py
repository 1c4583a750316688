"""Vector codes by product quantisation, its codebooks kept up to date by differences.

Vectors become integers once and are cut into parts; every part position has a codebook. A round of Lloyd assigns each part to its nearest entry and moves the
entries to the means of their parts. All sums are of integers, so they can be maintained instead of being made again: the assignments of the round before are kept as a table, and
a part adds to the sums only where its entry changed, with a plus for the new and a minus for the old. These differences are summed up in each chunk of vectors and in
each task before they are shuffled, at most a row for each part position and entry. Vectors and assignments are tables bucketed by chunk, so a round joins them without a shuffle
and writes only codes.

What the driver holds are the codebooks and their sums, whose size depends on the entries and the length of a vector alone.

Defined cases: a vector that is null or holds null or non-finite numbers is left out, as are vectors that have not the most frequent length (the longest of
equally frequent ones) and those whose length no number of equal parts gives; fewer vectors than entries make as many entries as there are vectors; of rows with equal ids the smaller vectors come first; a row with a
null id is encoded but is no first entry; a null label is a label; a table without vectors gives no rows. Numbers whose squares may not fit 64 bits raise an error instead
of a wrong sum. Columns besides id, vector and label are left alone."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import map_arrow, materialise, shared_path, ship

#: Vectors of a chunk.
CHUNK = 4096
#: Integer components are below this in absolute value.
BOUND = 1 << 25

_CHUNK = "chunk long, ids binary, known binary, labels binary, labelled binary, vectors binary"
_STATE = "chunk long, codes binary, entries binary, differences binary"


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("long").alias("label"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(fine & (F.size("vector") > 0), F.lit(False)))


def as_integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component."""
    scaled = np.floor(scale * vectors)
    if len(scaled) and np.abs(scaled).max() >= BOUND:
        raise ValueError(f"components beyond {BOUND // scale} are too large for exact sums")
    return scaled.astype(np.int64)


def assign(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part of each vector, the first of equally near ones, and its squared distance. vectors: (n, parts, length); books: (parts, entries, length)."""
    codes = np.empty(vectors.shape[:2], np.int64)
    least = np.empty(vectors.shape[:2], np.int64)
    for p, book in enumerate(books):
        own = vectors[:, p]
        far = np.stack([((own - entry) ** 2).sum(1) for entry in book], axis=1)
        codes[:, p] = far.argmin(1)
        least[:, p] = np.take_along_axis(far, codes[:, p : p + 1], 1)[:, 0]
    return codes, least


def differences(vectors: np.ndarray, codes: np.ndarray, before: np.ndarray | None, entries: int) -> np.ndarray:
    """(parts, entries, 1 + length): what changed parts add to the counts and sums of entries."""
    n, parts, length = vectors.shape
    out = np.zeros((parts, entries, 1 + length), np.int64)
    for p in range(parts):
        moved = np.flatnonzero(codes[:, p] != before[:, p]) if before is not None else np.arange(n)
        what = np.concatenate([np.ones((len(moved), 1), np.int64), vectors[moved, p]], axis=1)
        np.add.at(out[p], codes[moved, p], what)
        if before is not None:
            np.subtract.at(out[p], before[moved, p], what)
    return out


def _packed(parts: int, scale: int):
    """A row for each chunk of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            nonlocal made
            made += 1
            flat = table.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            row = [made]
            for c in (0, 2):
                column = table.column(c).combine_chunks()
                row += [column.fill_null(0).to_numpy(zero_copy_only=False).tobytes(), column.is_valid().to_numpy(zero_copy_only=False).tobytes()]
            row.append(as_integers(flat, scale).astype(np.int32).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["chunk", "ids", "known", "labels", "labelled", "vectors"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= CHUNK:
                table = pa.Table.from_batches(held)
                yield flush(table.slice(0, CHUNK))
                held, size = table.slice(CHUNK).to_batches(), size - CHUNK
        if size:
            yield flush(pa.Table.from_batches(held))

    return run


def _assigned(books):
    """Rows (chunk, codes, places among the entries of all parts, what their counts and sums change by) from rows (chunk, vectors, codes before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, length = books.value.shape
        for batch in batches:
            rows = []
            for chunk, vectors, before in zip(*(batch.column(k) for k in range(3)), strict=True):
                own = np.frombuffer(vectors.as_py(), np.int32).reshape(-1, parts, length).astype(np.int64)
                old = np.frombuffer(before.as_py(), np.uint8).reshape(-1, parts).astype(np.int64) if before.is_valid else None
                codes, _ = assign(own, books.value)
                change = differences(own, codes, old, entries).reshape(parts * entries, -1)
                where = np.flatnonzero(change.any(1))
                rows.append((chunk.as_py(), codes.astype(np.uint8).tobytes(), where.astype(np.int32).tobytes(), change[where].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["chunk", "codes", "entries", "differences"])

    return run


def _summed(size: int, width: int):
    """Rows (place, sums): the differences of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, width), np.int64)
        for batch in batches:
            for where, change in zip(batch.column(0), batch.column(1), strict=True):
                np.add.at(total, np.frombuffer(where.as_py(), np.int32), np.frombuffer(change.as_py(), np.int64).reshape(-1, width))
        where = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(total[where].tolist(), pa.list_(pa.int64()))], names=["place", "sums"])

    return run


def _encoded(books):
    """Rows (vec_id, label, code, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, length = books.value.shape
        for batch in batches:
            for ids, known, labels, labelled, vectors in zip(*(batch.column(k) for k in range(5)), strict=True):
                own = np.frombuffer(vectors.as_py(), np.int32).reshape(-1, parts, length).astype(np.int64)
                codes, least = assign(own, books.value)
                columns = [pa.array(np.frombuffer(x.as_py(), np.int64), mask=~np.frombuffer(y.as_py(), bool)) for x, y in ((ids, known), (labels, labelled))]
                texts = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(least.sum(1))], names=["vec_id", "label", "code", "error"])

    return run


@contextmanager
def _bucketed(spark: SparkSession) -> Iterator:
    """A function that writes a frame as a table bucketed by chunk, under the shared folder. The tables' names go at the end."""
    n, names = int(spark.conf.get("spark.sql.shuffle.partitions")), []

    def write(df: DataFrame, name: str) -> DataFrame:
        table = f"tessera_{name}_{uuid.uuid4().hex}"
        names.append(table)
        df.write.format("parquet").option("compression", "zstd").option("path", shared_path(spark, name)).bucketBy(n, "chunk").sortBy("chunk").saveAsTable(table)
        return spark.table(table)

    try:
        yield write
    finally:
        for table in names:
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def moved(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The entries at the floors of their parts' means; unused ones stay."""
    count = sums[:, :, :1]
    return np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, code, error) of the usable vectors, and the codebooks (parts, entries, length). code: an index for each part, as two hex
    digits; error: the squared distances of its parts to their entries."""
    spark = vectors.sparkSession
    ship(spark)
    shape = "vec_id long, label long, code string, error long"
    usable = _usable(vectors, id_col, vector_col, label_col)
    length = usable.where(F.size("vector") % parts == 0).groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return spark.createDataFrame([], shape), np.zeros((parts, 0, 0), np.int64)
    usable = usable.where(F.size("vector") == length["n"])
    first = usable.where("vec_id is not null").orderBy("vec_id", "vector").limit(entries).select("vector").collect() or usable.orderBy("vector").limit(entries).select("vector").collect()
    books = as_integers(np.array([r["vector"] for r in first]), scale).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    width = books.shape[2] + 1
    sums = np.zeros((parts, len(first), width), object)  # of Python's integers, which no table outgrows
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _bucketed(spark) as bucketed:
        packed = usable.select("vec_id", "vector", "label").transform(map_arrow, _packed(parts, scale), _CHUNK)
        chunks = bucketed(packed.repartition(n, "chunk"), "vectors")
        state = None
        for r in range(rounds):
            rows = chunks.select("chunk", "vectors", F.lit(None).cast("binary").alias("codes")) if state is None else chunks.join(state, "chunk").select("chunk", "vectors", "codes")
            state = bucketed(rows.transform(map_arrow, _assigned(spark.sparkContext.broadcast(books)), _STATE), f"codes{r}")
            change = state.select("entries", "differences").transform(map_arrow, _summed(parts * len(first), width), "place long, sums array<long>")
            change = change.select("place", F.posexplode("sums").alias("at", "x")).groupBy("place", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).where("x != 0").collect()
            for x in change:
                sums.reshape(-1, width)[x["place"], x["at"]] += int(x["x"])
            if not change and r:
                break
            books = moved(books, sums).astype(np.int64)
            state = state.select("chunk", "codes")
        coded = chunks.select("ids", "known", "labels", "labelled", "vectors").transform(map_arrow, _encoded(spark.sparkContext.broadcast(books)), shape)
        return materialise(coded, "codes"), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the errors of all rows with its label, nulls together."""
    of = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(of, F.col("label").eqNullSafe(F.col("of"))).drop("of")
