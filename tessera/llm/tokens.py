"""Token ids in Arrow files of fixed-size lists.

Documents are dealt out by ranges of ids and sorted; each task encodes its range and packs the ids, with an end id after
each document, into sequences of equal length. A file holds record batches with columns ``ids`` (fixed-size list of 16-bit
or 32-bit numbers) and ``mask`` (fixed-size list of booleans, false in the filling of the last sequence), uncompressed,
so that a mapped file gives any sequence by its number without copying. Columns ``doc_ids`` and ``doc_starts`` list for
each sequence the documents that begin in it and where in the file.

The files are in the Arrow file format, which a stream of batches precedes. Spark's text writer writes them, as it takes bytes as they are
and can write wherever Spark can: its line separator is the format's closing magic, so a row is a file without that.

Defined cases: a null text is an empty one and has the end id alone; rows with equal ids follow each other, in the order of a hash of their texts, and
need not be in one file; a null id comes first; an empty table makes no files and no rows; other columns are not looked at."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.wordhash import byte_slices, mix
from tessera.session import map_arrow, materialise, shared_path, ship

#: The Arrow file format's magic, which begins and ends a file.
MAGIC = "ARROW1"
#: Ids after which a new file begins, at the end of a document, unless asked otherwise. A task holds a file about five times.
FILE_IDS = 2 << 20
#: Ids of a sequence, and sequences of a record batch.
SEQUENCE, BATCH = 2048, 256
#: Places in a worker's table of known pieces, tries to find one, ids kept for them, and new pieces that are encoded at a time.
PLACES, TRIES, KEPT, TOGETHER = 1 << 19, 8, 1 << 21, 4096
_rng = np.random.Generator(np.random.PCG64(8))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(int(_rng.integers(1, 1 << 62)) * 2 + 1)
_CHECK = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _irregular(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold white space other than single blanks and line breaks between other characters."""
    blank = _BLANK[data]
    bad = blank & (data != 32) & (data != 10)
    bad[1:] |= blank[1:] & blank[:-1]
    begin, end = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
    bad[begin] |= blank[begin]
    bad[end] |= blank[end]
    if (data >= 0xC2).any():
        second, third = np.append(data[1:], np.uint8(0)), np.append(data[2:], np.zeros(min(2, len(data)), np.uint8))
        bad |= (data == 0xC2) & ((second == 0x85) | (second == 0xA0))
        bad |= (data == 0xE1) & (second == 0x9A) & (third == 0x80)
        bad |= (data == 0xE2) & ((second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)) | (second == 0x81) & (third == 0x9F))
        bad |= (data == 0xE3) & (second == 0x80) & (third == 0x80)
    return np.add.reduceat(np.append(bad, False).astype(np.int64), offsets[:-1]) * (offsets[1:] > offsets[:-1]) > 0 if len(offsets) > 1 else np.zeros(0, bool)


@dataclass
class Plan:
    """What the driver reads off a tokenizer, so that tasks need not: the size of its vocabulary, which tokens begin with a blank, the token of a
    line break (-1: none), and whether texts may be encoded by piece."""

    path: str
    size: int
    opens: bytes
    line: int
    by_piece: bool

    @classmethod
    def of(cls, path: str) -> Plan:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        opens = np.zeros(size, bool)
        for token, number in tokenizer.get_vocab(with_added_tokens=True).items():
            opens[number] = token.startswith("Ġ")
        line = tokenizer.token_to_id("Ċ")
        about = json.loads(tokenizer.to_str())
        step = about.get("pre_tokenizer") or {}
        by_piece = about.get("normalizer") is None and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space", True) and not any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] for x in about.get("added_tokens", []))
        return cls(path, size, opens.tobytes(), -1 if line is None else line, by_piece)

    @property
    def kind(self) -> np.dtype:
        return np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)


_kept: dict[str, object] = {}


def _tokenizer(path: str):
    """The tokenizer of this worker. It stays for the worker's next task, as the library does not give all memory back when one is dropped."""
    if path not in _kept:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _kept.clear()
        _kept[path] = Tokenizer.from_file(path)
    return _kept[path]


class Encoder:
    """Encodes with a tokenizer. Byte-level BPE splits a text before each blank that a word follows, at line breaks, and between a
    letter and a mark that ends a word, whatever stands beside; so the ids of a text are those of such pieces, and a piece is
    encoded once as long as it is remembered. Pieces are told apart by two independent hashes of 64 bits each. Texts with other
    white space, and all texts of other tokenizers, are encoded whole."""

    def __init__(self, plan: Plan):
        self.tokenizer = _tokenizer(plan.path)
        self.kind, self.line, self.by_piece = plan.kind, plan.line, plan.by_piece
        self.opens = np.frombuffer(plan.opens, bool)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.uint64)
        self.at, self.size = np.zeros(PLACES, np.int32), np.zeros(PLACES, np.int32)
        self.ids, self.used, self.known = np.zeros(KEPT, self.kind), 0, 0

    def _keep(self, ids: np.ndarray) -> int:
        """Where these ids are kept from now on."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(KEPT, len(ids)), self.kind)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new pieces are kept, and how many they are. Pieces after a blank are encoded in a row, as their ids tell where
        each begins, others with line breaks between them."""
        at, size = np.zeros(len(pieces), np.int32), np.zeros(len(pieces), np.int32)
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        for i, piece in enumerate(pieces):
            kinds[0 if piece[0] == " " else 2 if piece == "\n" else 1].append(i)
        for which, mine in enumerate(kinds):
            for k in range(0, len(mine), TOGETHER):
                some = np.array(mine[k : k + TOGETHER])
                ids = self._encoded(("\n" if which == 1 else "").join(pieces[i] for i in some))
                if which == 1:
                    cuts = np.flatnonzero(ids == self.line)
                    begin, end = np.concatenate([[0], cuts + 1]), np.append(cuts, len(ids))
                else:
                    begin = np.flatnonzero(self.opens[ids]) if which == 0 else np.zeros(1, np.int64)
                    end = np.append(begin[1:], len(ids))
                if len(begin) == len(some):
                    at[some], size[some] = begin + self._keep(ids), end - begin
                else:
                    for i in some:
                        own = self._encoded(pieces[i])
                        at[i], size[i] = self._keep(own), len(own)
        return at, size

    def _find(self, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each piece in the table and whether it is there."""
        place = (hashes & np.uint64(PLACES - 1)).astype(np.int64)
        there = (self.keys[place] == hashes) & (self.checks[place] == checks)
        for _ in range(1, TRIES):
            rest = np.flatnonzero(~there & (self.keys[place] != 0))
            if not len(rest):
                break
            place[rest] = (place[rest] + 1) & (PLACES - 1)
            there[rest] = (self.keys[place[rest]] == hashes[rest]) & (self.checks[place[rest]] == checks[rest])
        return place, there

    def _remember(self, hashes: np.ndarray, checks: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        place = (hashes & np.uint64(PLACES - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        for _ in range(TRIES):
            free = left[self.keys[place[left]] == 0]
            _, first = np.unique(place[free], return_index=True)
            put = free[first]
            self.keys[place[put]], self.checks[place[put]], self.at[place[put]], self.size[place[put]] = hashes[put], checks[put], at[put], size[put]
            self.known += len(put)
            left = np.setdiff1d(left, put, assume_unique=True)
            if not len(left):
                break
            place[left] = (place[left] + 1) & (PLACES - 1)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers): the ids of the texts data[offsets[i]:offsets[i+1]], each followed by ``end_id``, and how many each has."""
        if self.known > PLACES // 2 or self.used > KEPT:
            self._forget()
        n = len(offsets) - 1
        whole = _irregular(data, offsets) if self.by_piece else np.ones(n, bool)
        opens = (data == 32) | (data == 10)
        opens[1:] |= data[:-1] == 10
        after = np.append(_BLANK[data[1:]], True) if len(data) else opens
        after[offsets[1:][offsets[1:] > 0] - 1] = True
        opens[1:] |= ((data[1:] == 46) | (data[1:] == 44)) & _LETTER[data[:-1]] & after[1:]
        opens[offsets[:-1][offsets[:-1] < len(data)]] = True
        begin = np.flatnonzero(opens)
        doc = np.searchsorted(offsets, begin, "right") - 1
        lengths = np.diff(begin, append=len(data))
        regular = ~whole[doc]
        at, size = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int32)
        if len(begin):
            powers = np.full(int(lengths.max()), _BASE, np.uint64)
            powers[0] = 1
            np.cumprod(powers, out=powers)
            powers = powers[np.arange(len(data)) - np.repeat(begin, lengths)]
            hashes = mix(np.add.reduceat(_BYTE[data] * powers, begin)) | np.uint64(1 << 63)
            checks = np.add.reduceat(_CHECK[data] * powers, begin)
            place, there = self._find(hashes, checks)
            at, size = self.at[place], self.size[place]
            new = np.flatnonzero(~there & regular)
            if len(new):
                order = np.lexsort((checks[new], hashes[new]))
                differs = np.ones(len(new), bool)
                differs[1:] = (np.diff(hashes[new][order]) != 0) | (np.diff(checks[new][order]) != 0)
                first, back = order[differs], np.empty(len(new), np.int64)
                back[order] = np.cumsum(differs) - 1
                text = data.tobytes()
                pieces = [text[a:b].decode() for a, b in zip(begin[new[first]].tolist(), (begin + lengths)[new[first]].tolist(), strict=True)]
                where, number = self._learn(pieces)
                at[new], size[new] = where[back], number[back]
                self._remember(hashes[new[first]], checks[new[first]], where, number)
            size[~regular] = 0
        # a text that is encoded whole counts as one piece; the end id is a piece of each text
        ends = np.searchsorted(doc, np.arange(n), "right")
        more_at, more_size = np.full(n, self._keep(np.array([end_id], self.kind)), np.int32), np.ones(n, np.int32)
        for i in np.flatnonzero(whole):
            ids = np.append(self._encoded(data[offsets[i] : offsets[i + 1]].tobytes().decode()), np.array(end_id, self.kind))
            more_at[i], more_size[i] = self._keep(ids), len(ids)
        at, size = np.insert(at, ends, more_at), np.insert(size, ends, more_size)
        run = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(at - run[:-1], size) + np.arange(int(run[-1]))]
        return ids, np.diff(run[np.append(0, ends + np.arange(1, n + 1))])


def arrow_file(ids: np.ndarray, docs: list[tuple[int | None, int]], fill: int, about: dict[str, str], sequence: int = SEQUENCE) -> pa.Buffer:
    """A file of these ids; docs: the documents in order, with the place at which each begins."""
    rows = max(1, -(-len(ids) // sequence))
    padded = np.full(rows * sequence, fill, ids.dtype)
    padded[: len(ids)] = ids
    mask = np.arange(rows * sequence) < len(ids)
    starts = np.array([s for _, s in docs], np.int64)
    edges = np.searchsorted(starts // sequence, np.arange(rows + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x, pa.int64())) for x in ([d for d, _ in docs], starts)]
    columns = [pa.FixedSizeListArray.from_arrays(pa.array(padded), sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), sequence), *lists]
    table = pa.RecordBatch.from_arrays(columns, names=["ids", "mask", "doc_ids", "doc_starts"])
    table = table.replace_schema_metadata({**about, "n_ids": str(len(ids))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as out:
        for k in range(0, rows, BATCH):
            out.write_batch(table.slice(k, BATCH))
    return sink.getvalue()


def open_arrow(source) -> tuple[np.ndarray, list[tuple[int | None, int]], dict[str, str]]:
    """(ids, documents, about) of a file, from bytes or a mapped file; the ids of one batch are not copied."""
    reader = pa.ipc.open_file(source)
    about = {k.decode(): v.decode() for k, v in reader.schema.metadata.items()}
    parts, docs = [], []
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        parts.append(batch.column(0).flatten().to_numpy(zero_copy_only=True)[: int(np.count_nonzero(batch.column(1).flatten().to_numpy(zero_copy_only=False)))])
        docs += zip(batch.column(2).flatten().to_pylist(), batch.column(3).flatten().to_pylist(), strict=True)
    return parts[0] if len(parts) == 1 else np.concatenate(parts), docs, about


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, file_ids: int = FILE_IDS) -> None:
    """Write the files of all rows of ``docs`` under ``path``. tokenizer: a file that the driver and all executors have at this place. file_ids: ids of a
    file, about; where executors have the memory, 128 Mi ids make files of 256 MB."""
    spark = docs.sparkSession
    ship(spark)
    plan = Plan.of(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(plan)  # its tables are gone with the task
        task, number = TaskContext.get().partitionId(), 0
        held, names, begins, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, names, begins, size
            ids, docs = np.concatenate(held), list(zip([x for y in names for x in y], np.concatenate(begins).tolist(), strict=True))
            held, names, begins, size = [], [], [], 0
            data = arrow_file(ids, docs, end_id, {"task": str(task), "number": str(number)}, sequence)
            number += 1
            # without a copy, and without the magic at its end
            size_of = pa.py_buffer(np.array([0, data.size - len(MAGIC)], np.int32))
            return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), 1, [None, size_of, data])], names=["file"])

        for batch in batches:
            own_names = batch.column(0).to_pylist()
            for rows, data, offsets in byte_slices(batch.column(1), 1 << 19):
                ids, numbers = own.encode(data, offsets, end_id)
                names.append(own_names[rows])
                begins.append(size + np.cumsum(numbers) - numbers)
                held.append(ids)
                size += len(ids)
                if size >= file_ids:
                    yield flush()
        if held:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of one id, and equal rows, may fill several ranges
    name = F.col("doc_id").asc_nulls_first()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).alias("salt"))
    files = rows.repartitionByRange(n, name, "h", "salt").sortWithinPartitions(name, "h").select("doc_id", "text").transform(map_arrow, run, "file binary")
    files.select(F.col("file").cast("string")).write.option("lineSep", MAGIC).option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the files; start counts the ids of all documents before it."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "place", "n_tokens", "ids_crc32", "task", "number", "n_ids"]
        for batch in batches:
            for value in batch.column(0):
                ids, docs, about = open_arrow(value.as_buffer())
                edges = [*(s for _, s in docs), len(ids)]
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
                rest = [pa.array([int(about[x])] * len(docs), pa.int64()) for x in ("task", "number", "n_ids")]
                columns = [pa.array([d for d, _ in docs], pa.int64()), pa.array(edges[:-1], pa.int64()), pa.array(np.diff(edges), pa.int64()), pa.array(sums, pa.int64()), *rest]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = materialise(files.transform(map_arrow, run, "doc_id long, place long, n_tokens long, ids_crc32 long, task long, number long, n_ids long"), "token-index")
    # files are numbered within their task; only the tasks' sums, a row for each range of ids, meet in one task
    sizes = rows.groupBy("task", "number").agg(F.first("n_ids").alias("n_ids"))
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = sizes.select("task", "number", earlier(Window.partitionBy("task").orderBy("number")).alias("inside"))
    tasks = sizes.groupBy("task").agg(F.sum("n_ids").alias("n_ids")).select("task", earlier(Window.orderBy("task")).alias("outside"))
    offsets = within.join(tasks, "task").select("task", "number", (F.col("inside") + F.col("outside")).alias("before"))
    return rows.join(offsets, ["task", "number"]).select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def documents_through_files(docs: DataFrame, tokenizer: str, end_id: int = 0, **options) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return what the files hold."""
    path = shared_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id, **options)
    return read_token_files(docs.sparkSession, path)
