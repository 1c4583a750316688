"""Line deduplication by a sharded minimal perfect hash.

A line's key is the line without blanks at its ends, lower-cased; keys are told apart by hashes of 128 bits. Each task sums up a chunk of texts: its distinct keys, in how many
documents of the chunk each is and in which last, and which document holds which key. Keys are dealt to shards by their hash. A shard's index is a minimal perfect hash over its distinct keys
and, at the places it gives, arrays of fingerprints, numbers of documents and last documents. Then each chunk probes the arrays: the keys that it has in a shard travel there as one packed row, and
what they are told goes back to the chunk, which knows its documents. No lines are joined, and a line that a third of all documents share is asked for once by each chunk.

A shard has SHARD_KEYS keys on average at every size of the table, so what a task holds is bounded: an index, and a chunk's keys.

Defined cases: a null or empty text is one empty line; each row is a document, so rows with equal ids are counted one by one, and all of them keep the
lines of which their id is the largest; a row with a null id keeps all lines and is not counted; an empty table gives no rows; columns besides the id and the text are left alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.perfect_hash import PerfectHash
from tessera.llm.wordhash import mix
from tessera.session import map_arrow, materialise, ship

#: What a key is stripped of at both ends.
BLANKS = " \t\n\x0b\x0c\r"
#: A chunk ends at so many keys or characters, or with the task.
CHUNK_KEYS, CHUNK_CHARS = 1 << 17, 32 << 20
#: Keys of a shard, on average at most.
SHARD_KEYS = 1 << 16

_CHUNK = "chunk long, n_keys long, keys binary, counts binary, lasts binary, owners binary, held binary"
_PROBE = "shard long, chunk long, one binary, two binary"
_ANSWER = "chunk long, kind int, one binary, two binary"


def line_key(line: str, least_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key, none if the key is too short to count."""
    key = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= least_chars else None


def _batch(rows: list[tuple], shape: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in shape.split(", ")), strict=True)
    types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k] for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _chunks(least_chars: int):
    """A row for each chunk: its distinct keys, in how many documents each is and the last of them, and pairs (owner, place of a key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        places: dict[bytes, int] = {}
        counts, lasts, owners, held = [], [], [], []
        chars = made = 0

        def flush() -> pa.RecordBatch:
            arrays = (np.array(counts, np.int64), np.array(lasts, np.int64), np.array(owners, np.int64), np.array(held, np.int32))
            return _batch([(task + made, len(places), b"".join(places), *(x.tobytes() for x in arrays))], _CHUNK)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                chars += len(text)
                own = {key for line in text.split("\n") if (key := line_key(line, least_chars))}
                for key in own:
                    at = places.setdefault(key, len(places))
                    if at == len(counts):
                        counts.append(0)
                        lasts.append(doc)
                    counts[at] += 1
                    lasts[at] = max(lasts[at], doc)
                    owners.append(doc)
                    held.append(at)
                if len(places) >= CHUNK_KEYS or len(held) >= 4 * CHUNK_KEYS or chars >= CHUNK_CHARS:
                    yield flush()
                    made += 1
                    places, counts, lasts, owners, held, chars = {}, [], [], [], [], 0
        if places:
            yield flush()

    return run


def _halves(keys: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(keys, np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _shard_of(high: np.ndarray, low: np.ndarray, shards: int) -> np.ndarray:
    return (mix(high ^ mix(low)) % np.uint64(shards)).astype(np.int64)


def _counted(shards: int):
    """Rows (shard, high, low, n, last) of a chunk's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts, lasts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                high, low = _halves(keys)
                columns = (_shard_of(high, low, shards), high.view(np.int64), low.view(np.int64), np.frombuffer(counts, np.int64), np.frombuffer(lasts, np.int64))
                for a in range(0, len(high), 1 << 15):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 15)]) for c in columns], names=["shard", "high", "low", "n", "last"])

    return run


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions come sorted by shard, a row (shard, high, low, n, last) for each distinct key. A row (shard, hash, arrays) for each shard."""
    shard: int | None = None
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        high, low, n, last = (np.concatenate(x) for x in zip(*held, strict=True))
        high, low = high.view(np.uint64), low.view(np.uint64)
        index, place = PerfectHash.of(high, low)
        prints, counts, lasts = np.empty(len(high), np.uint32), np.empty(len(high), np.uint32), np.empty(len(high), np.int64)
        prints[place] = (low >> np.uint64(32)).astype(np.uint32)
        counts[place] = np.minimum(n, 2**32 - 1)
        lasts[place] = last
        return _batch([(shard, -1, index.to_bytes(), prints.tobytes() + counts.tobytes() + lasts.tobytes())], _PROBE)

    for batch in batches:
        own, *columns = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        turns = np.flatnonzero(np.diff(own)) + 1
        for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(own)], strict=True):
            if a < b:
                if own[a] != shard:
                    if held:
                        yield flush()
                    shard, held = int(own[a]), []
                held.append(tuple(c[a:b] for c in columns))
    if held:
        yield flush()


def _probes(shards: int):
    """Rows (shard, chunk, keys, places of the keys in the chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                both = np.frombuffer(keys, np.uint64).reshape(-1, 2)
                shard = _shard_of(both[:, 0], both[:, 1], shards)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
                parts = np.split(order, cuts[1:]) if len(order) else []
                if parts:
                    yield _batch([(int(shard[p[0]]), chunk, both[p].tobytes(), p.astype(np.int32).tobytes()) for p in parts], _PROBE)

    return run


def _answered(least: int):
    """Partitions come sorted by shard, its index first. Rows (chunk, 0, places in the chunk, last documents) of the keys that enough documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, arrays = None, ()
        for batch in batches:
            out = []
            for chunk, one, two in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                chunk, one, two = chunk.as_py(), one.as_py(), two.as_py()
                if chunk < 0:
                    index, n = PerfectHash.from_bytes(one), len(two) // 16
                    arrays = np.frombuffer(two, np.uint32, n), np.frombuffer(two, np.uint32, n, 4 * n), np.frombuffer(two, np.int64, n, 8 * n)
                    continue
                prints, counts, lasts = arrays
                high, low = _halves(one)
                place = index.places(high, low)
                known = (place >= 0) & (prints[place] == (low >> np.uint64(32)).astype(np.uint32))
                if not known.all():  # every key that is asked for was counted
                    raise RuntimeError(f"chunk {chunk} has {int((~known).sum())} lines that its shard does not know")
                many = counts[place] >= least
                if many.any():
                    out.append((chunk, 0, np.frombuffer(two, np.int32)[many].tobytes(), lasts[place[many]].tobytes()))
            if out:
                yield _batch(out, _ANSWER)

    return run


def _lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions come sorted by chunk, the answers first; then (1, keys) and (2, owners and places). Rows (doc_id, gone): the keys that a document loses, one after the other."""
    last: dict[int, int] = {}
    now, keys = None, b""
    for batch in batches:
        for chunk, kind, one, two in zip(*(batch.column(k) for k in range(4)), strict=True):
            if (chunk := chunk.as_py()) != now:
                now, last = chunk, {}
            one, two = one.as_py(), two.as_py()
            if kind.as_py() == 0:
                last |= zip(np.frombuffer(one, np.int32).tolist(), np.frombuffer(two, np.int64).tolist(), strict=True)
            elif last:
                keys = one
                owners, held = np.frombuffer(two, np.int64, len(two) // 12), np.frombuffer(two, np.int32, len(two) // 12, len(two) // 12 * 8)
                gone: dict[int, list[int]] = {}
                for i in np.flatnonzero(np.isin(held, np.fromiter(last, np.int32))).tolist():
                    doc, at = int(owners[i]), int(held[i])
                    if last[at] != doc:
                        gone.setdefault(doc, []).append(at)
                if gone:
                    rows = [(doc, b"".join([keys[16 * at : 16 * at + 16] for at in sorted(set(places))])) for doc, places in gone.items()]
                    yield _batch(rows, "doc_id long, gone binary")


def common_lines(docs: DataFrame, least_documents: int = 3, least_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, gone): the keys, as 16 bytes each, of at least ``least_chars`` code points that at least ``least_documents`` documents hold and a larger id than the document's does, too. Documents
    without such keys have no row."""
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    chunks = materialise(texts.transform(map_arrow, _chunks(least_chars), _CHUNK), "chunks")
    shards = max(1, -(-(chunks.agg(F.sum("n_keys")).first()[0] or 0) // SHARD_KEYS))
    keys = chunks.select("keys", "counts", "lasts").transform(map_arrow, _counted(shards), "shard long, high long, low long, n long, last long")
    keys = keys.repartition(n, "shard").groupBy("shard", "high", "low").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    index = materialise(keys.sortWithinPartitions("shard").transform(map_arrow, _indexed, _PROBE), "index")
    probes = index.union(chunks.select("chunk", "keys").transform(map_arrow, _probes(shards), _PROBE))
    told = probes.repartition(n, "shard").sortWithinPartitions("shard", "chunk").transform(map_arrow, _answered(least_documents), _ANSWER)
    own = chunks.select("chunk", F.lit(1).alias("kind"), F.col("keys").alias("one"), F.concat("owners", "held").alias("two"))
    return told.union(own).repartition(n, "chunk").sortWithinPartitions("chunk", "kind").transform(map_arrow, _lost, "doc_id long, gone binary")


def _kept(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, gone in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py() or ""
                lines = kept = text.split("\n")
                if gone.values is not None and len(gone.values):
                    lost = {x[k : k + 16] for x in gone.as_py() for k in range(0, len(x), 16)}
                    kept = [x for x in lines if line_key(x, least_chars) not in lost]
                    text = "\n".join(kept)
                rows.append((len(lines), len(lines) - len(kept), text))
            found = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return run


def without_common_lines(docs: DataFrame, least_documents: int = 3, least_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of each row: kept is the text without the lines whose key has at least ``least_chars`` code points and is
    in at least ``least_documents`` documents, of which one with a larger id keeps them."""
    gone = common_lines(docs, least_documents, least_chars, id_col, text_col).groupBy(F.col("doc_id").alias("owner")).agg(F.collect_list("gone").alias("gone"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(gone, F.col("doc_id") == F.col("owner"), "left").select("doc_id", "text", "gone")
    return rows.transform(map_arrow, _kept(least_chars), "doc_id long, n_lines long, n_dropped long, kept string")
