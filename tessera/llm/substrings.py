"""Substring deduplication by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Windows that begin at neighbouring words and share a minimiser, the
smallest hash of a run of MINIMISER words in them, travel as one packed string of words to the bucket of that minimiser;
equal windows have equal minimisers and so meet. There the strings are unpacked and their windows sorted and counted. Windows are told
apart by fingerprints of 128 bits, not word by word.

A minimiser that very many strings share would make its bucket large, whatever the number of buckets. So these are counted first, and windows of a frequent
minimiser go to the bucket of it and of a second minimiser, by other hashes. That, too, depends on the window alone.

Each task first drops what it can decide alone: of a window that several documents of a chunk hold, only those of the
smallest id ask their bucket, the others are covered already. So a passage that a third of all documents share is sent once
for each chunk, not for each document.

Covered words come back as runs with a hash of their words, and a row loses only runs that it has itself.

Defined cases: a null or empty text has no words; documents of fewer words than a window keep all; a row with a null id neither
covers nor is covered; rows with equal ids do not cover each other, and each loses what it shares with smaller ids; an empty table gives no rows; columns
besides the id and the text are left alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.wordhash import Words, find_words, mix, text_slices
from tessera.session import map_arrow, materialise, ship

#: Words whose hashes choose a minimiser.
MINIMISER = 3
#: Bytes of text of which a task looks for repeats alone.
CHUNK_BYTES = 3 << 20
#: Buckets for each shuffle partition.
BUCKETS = 2
#: A task reports a minimiser of so many strings of a chunk; a minimiser is frequent if it has that share of a mean bucket.
REPORTED, SHARE = 16, 0.25

_FIELDS = ["bucket", "docs", "places", "runs", "text"]
_SHAPE = "bucket int, docs binary, places binary, runs binary, text binary"
_RANGE = "doc_id long, first int, end int, mark long"


def _sliding_minimum(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of values[i:i+n] for each i; beyond the end there are no smaller values."""
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out, np.concatenate([out[step:], np.full(step, np.uint64(2**64 - 1))])[: len(out)])
        have += step
    return out


def _later(first: np.ndarray, second: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Places of windows that occur in a document with a smaller id too; fingerprints are (first, second)."""
    order = np.argsort(first, kind="stable")
    same = first[order[1:]] == first[order[:-1]]
    part = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
    part = part[np.lexsort((docs[part], second[part], first[part]))]
    a, b, d = first[part], second[part], docs[part]
    lead = np.ones(len(part), bool)
    lead[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = d[np.maximum.accumulate(np.where(lead, np.arange(len(part)), 0))] if len(part) else d
    return part[d > least]


def _marks(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words words[begin:end] of each run, from hashes of the words."""
    sizes = end - begin
    edge = np.cumsum(sizes) - sizes
    offset = np.arange(int(sizes.sum())) - np.repeat(edge, sizes)
    mixed = mix(words[np.repeat(begin, sizes) + offset] + offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.add.reduceat(mixed, edge) if len(sizes) else np.zeros(0, np.uint64)


def _ranges(docs: np.ndarray, places: np.ndarray, at: np.ndarray, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of covered words (doc, first, end, mark) from windows that begin at these places of their documents; at: where the window is in ``words``. A
    run's windows follow each other in ``words`` as they do in the document."""
    order = np.lexsort((at, places, docs))
    docs, places, at = docs[order], places[order].astype(np.int64), at[order]
    new = np.ones(len(docs), bool)
    step = places[1:] - places[:-1]
    new[1:] = (docs[1:] != docs[:-1]) | (step > window) | (at[1:] - at[:-1] != step)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(docs))[: len(begin)] - 1
    return docs[begin], places[begin], places[last] + window, _marks(words, at[begin], at[last] + window)


def _minimisers(part: Words, window: int, seed: int) -> np.ndarray:
    """For each word, the smallest hash of MINIMISER words in the window that begins there."""
    hashes = part.hashes(seed)
    padded = np.concatenate([hashes, np.zeros(MINIMISER, np.uint64)])
    short = mix(sum(padded[j : j + len(hashes)] * np.uint64(2 * j * 0x51ED270B + 0x2545F4914F6CDD1D) for j in range(MINIMISER)))
    return _sliding_minimum(short, window - MINIMISER + 1)


def _window_places(part: Words, edge: np.ndarray) -> np.ndarray:
    """The word at which each window begins."""
    counts = np.diff(edge)
    return np.arange(int(edge[-1])) + np.repeat(part.first[:-1] - edge[:-1], counts)


def _frequent(window: int):
    """Rows (minimiser, n): minimisers of many strings of a chunk, and under 0 the number of all strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(0), lower=False, most=CHUNK_BYTES):
                edge = np.concatenate([[0], np.cumsum(np.maximum(np.diff(part.first) - window + 1, 0))])
                if not edge[-1]:
                    continue
                at = _window_places(part, edge)
                least = _minimisers(part, window, 1)[at]
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
                found, counts = np.unique(least[new], return_counts=True)
                many = counts >= REPORTED
                keys, numbers = np.append(found[many], np.uint64(0)), np.append(counts[many], new.sum())
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(numbers.astype(np.int64))], names=["minimiser", "n"])

    return run


def _packed(window: int, buckets: int, frequent):
    def rows_of(part: Words, ids: np.ndarray, salt: int) -> Iterator[tuple]:
        hashes = part.hashes(1)
        first, edge = part.windows(hashes, window, short=False)
        if not len(first):
            return
        second, _ = part.windows(part.hashes(2), window, short=False)
        counts = np.diff(edge)
        doc = np.repeat(ids, counts)
        at = _window_places(part, edge)
        place = (at - np.repeat(part.first[:-1], counts)).astype(np.int32)
        asks = np.ones(len(first), bool)
        gone = _later(first, second, doc)
        asks[gone] = False
        if len(gone):
            d, a, b, m = _ranges(doc[gone], place[gone], at[gone], hashes, window)
            yield -1 - salt % buckets, d.tobytes(), a.astype(np.int32).tobytes(), b.astype(np.int32).tobytes(), m.tobytes()
        least = _minimisers(part, window, 1)[at]
        hot = np.isin(least, frequent.value)
        if hot.any():
            least[hot] = mix(least[hot] ^ mix(_minimisers(part, window, 2)[at[hot]]))
        where = np.flatnonzero(asks)
        new = np.ones(len(where), bool)
        new[1:] = (at[where[1:]] != at[where[:-1]] + 1) | (least[where[1:]] != least[where[:-1]])
        begin = np.flatnonzero(new)
        runs = np.diff(begin, append=len(where)).astype(np.int32)
        begin = where[begin]
        bucket = (mix(least[begin] + np.uint64(7)) % np.uint64(buckets)).astype(np.int64)
        whole, offset = part.joined()
        order = np.argsort(bucket, kind="stable")
        lows, highs = offset[at[begin]].tolist(), offset[at[begin] + runs + window - 1].tolist()
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            mine = order[cuts[k] : cuts[k + 1]]
            yield int(k), doc[begin[mine]].tobytes(), place[begin[mine]].tobytes(), runs[mine].tobytes(), b"".join([whole[lows[i] : highs[i]] for i in mine.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        salt = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in text_slices(batch.column(1), lower=False, most=CHUNK_BYTES):
                salt += int(part.first[-1]) + 1
                rows = list(rows_of(part, ids[part.rows], salt))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array([pack(x) for x in c], pa.binary()) for c in columns[1:])], names=_FIELDS)

    return run


def _counted(window: int):
    """Partitions come sorted by bucket. Rows (doc_id, first, end, mark) of covered words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        bucket: int | None = None
        held: list[tuple[np.ndarray, ...]] = []
        before = 0

        def found(doc: np.ndarray, a: np.ndarray, b: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(mark.view(np.int64))], names=["doc_id", "first", "end", "mark"])

        def flush() -> pa.RecordBatch:
            first, second, doc, place, at, words = (np.concatenate(x) for x in zip(*held, strict=True))
            gone = _later(first, second, doc)
            return found(*_ranges(doc[gone], place[gone], at[gone], words, window))

        for batch in batches:
            for i in range(batch.num_rows):
                k = batch.column(0)[i].as_py()
                docs, places, runs = (np.frombuffer(unpack(batch.column(c)[i].as_py()), kind) for c, kind in ((1, np.int64), (2, np.int32), (3, np.int32)))
                if k < 0:  # decided where the text was read
                    yield found(docs, places, runs, np.frombuffer(unpack(batch.column(4)[i].as_py()), np.uint64))
                    continue
                if k != bucket:
                    if held:
                        yield flush()
                    bucket, held, before = k, [], 0
                data = np.frombuffer(unpack(batch.column(4)[i].as_py()), np.uint8)
                words = find_words(data, np.array([0, len(data)]), slice(0, 1), lower=False)
                words.first = np.concatenate([[0], np.cumsum(runs + window - 1)])
                hashes = words.hashes(1)
                first, edge = words.windows(hashes, window, short=False)
                second, _ = words.windows(words.hashes(2), window, short=False)
                at = before + _window_places(words, edge).astype(np.int32)
                before += len(hashes)
                held.append((first, second, np.repeat(docs, runs), np.repeat(places - edge[:-1].astype(np.int32), runs) + np.arange(len(first), dtype=np.int32), at, hashes))
        if held:
            yield flush()

    return run


def frequent_minimisers(texts: DataFrame, window: int, buckets: int) -> np.ndarray:
    """The minimisers of SHARE of a mean bucket's strings or more, so at most buckets / SHARE of them."""
    rows = texts.select("text").transform(map_arrow, _frequent(window), "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    rows = materialise(rows, "minimisers")
    every = rows.where("minimiser = 0").agg(F.sum("n")).first()[0] or 0
    found = rows.where((F.col("minimiser") != 0) & (F.col("n") >= F.lit(max(1.0, SHARE * every / buckets)))).select("minimiser").collect()
    return np.array([r["minimiser"] for r in found], np.int64).view(np.uint64)


def repeated_ranges(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ranges): the runs [first, end) of words of a document that are covered by windows that also begin in a document with
    a smaller id, each with a hash of its words. Documents without such words have no row; runs may touch or overlap."""
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    frequent = spark.sparkContext.broadcast(frequent_minimisers(texts, window, n * BUCKETS))
    packed = texts.transform(map_arrow, _packed(window, n * BUCKETS, frequent), _SHAPE)
    covered = packed.repartition(n, "bucket").sortWithinPartitions("bucket").transform(map_arrow, _counted(window), _RANGE)
    return covered.groupBy("doc_id").agg(F.collect_list(F.struct("first", "end", "mark")).alias("ranges"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, numbers, removed, kept = batch.column(0), [], [], []
        for part in text_slices(batch.column(1), lower=False):
            whole, offset = part.joined()
            hashes = None
            for k, row in enumerate(range(part.rows.start, part.rows.stop)):
                a, b = int(part.first[k]), int(part.first[k + 1])
                gone = np.zeros(b - a + 2, np.int8)
                gone[[0, -1]] = 1
                runs = batch.column(2)[row].values
                if runs is not None and len(runs):
                    hashes = part.hashes(1) if hashes is None else hashes
                    low, high, mark = (runs.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                    # runs of another row with this id are left out
                    own = np.flatnonzero(high <= b - a)
                    own = own[_marks(hashes, a + low[own].astype(np.int64), a + high[own].astype(np.int64)).view(np.int64) == mark[own]]
                    for x, y in zip(low[own].tolist(), high[own].tolist(), strict=True):
                        gone[x + 1 : y + 1] = 1
                turns = np.diff(gone)
                lows, highs = np.flatnonzero(turns == -1) + a, np.flatnonzero(turns == 1) + a
                kept.append(b"".join([whole[x:y] for x, y in zip(offset[lows].tolist(), offset[highs].tolist(), strict=True)])[:-1])
                numbers.append(b - a)
                removed.append(b - a - int((highs - lows).sum()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(numbers, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row: kept is the text's words without the repeated ones, joined by single blanks."""
    ranges = repeated_ranges(docs, window, id_col, text_col).withColumnRenamed("doc_id", "covered_id")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(ranges, F.col("doc_id") == F.col("covered_id"), "left").select("doc_id", "text", "ranges")
    return rows.transform(map_arrow, _kept, "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))
