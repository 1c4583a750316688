"""Collocations: frequent phrases of neighbouring words, scored by how much more often they occur than their parts would together.

The n-grams of a corpus are too many to be counted exactly, and only those that occur often are wanted. So level by level, from single words to the longest phrases, a count-min sketch is made first:
each task adds its n-grams to a few rows of cells, sketches are merged by adding cells, and a cell never holds less than any of its n-grams. An n-gram is a survivor if all its cells
reach the least frequency and both its shorter n-grams survive, so no frequent one is lost; of a sketch just a bit for each cell is sent to all tasks. A last pass
counts the survivors of all levels exactly, summed up in each chunk of text before they are shuffled, packed by buckets of their hash. What the sketch overestimates falls out there. The exact counts of words and shorter phrases that scores
need are among them, as parts of a frequent phrase are frequent.

Sketches have CELLS cells in each of ROWS rows whatever the size of the table, so they take a bounded share of a task's memory. The more text there is, the more survivors are counted in the last pass for
nothing; results do not depend on it. ``cells`` asks for wider ones.

Within a chunk words are told apart by their bytes and phrases by their words; hashes only choose cells.

Defined cases: a null or empty text has no words, and its language has a count of words all the same; a null language is ``und``; punctuation ends phrases; repeated rows count each; an empty table gives no rows;
columns besides text and language are left alone."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tessera.llm.wordhash import byte_slices, find_words, mix
from tessera.session import map_arrow, materialise, ship

#: Rows of a sketch, and cells of a row: a power of two.
ROWS, CELLS = 2, 1 << 22
#: Bytes of text that a task looks at together.
CHUNK_BYTES = 4 << 20
#: Cells that travel together.
BLOCK = 1 << 16
#: Buckets of survivors for each shuffle partition.
BUCKETS = 4
#: Tasks that each find the best phrases of a language before one merges them.
DEALT = 16

#: What ends a piece becomes a line break, what else parts words stays a blank.
_ENDS = np.arange(256, dtype=np.uint8)
_ENDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 0x0A


class Chunk:
    """Words of some texts; ``langs`` has a number for each text and ``marks`` a hash for each number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, marks: np.ndarray):
        self.words = find_words(_ENDS[data], offsets, slice(0, len(langs)), lower=True)
        counts = np.diff(self.words.first)
        self.lang = np.repeat(langs, counts)
        self.marks = marks
        # a number for each piece, the same nowhere else
        breaks = np.cumsum(self.words.data == 0x0A, dtype=np.int32)
        self.piece = np.repeat(np.arange(len(langs), dtype=np.int32), counts) + breaks[self.words.start]

    def __len__(self) -> int:
        return len(self.words.start)

    def levels(self, longest: int, survive) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length the words at which n-grams begin both of whose shorter ones survive, a hash of each with its language, and which of them survive. survive: from a length and hashes to a mask."""
        own = self.words.hashes()
        at, hashes = np.arange(len(own)), mix(own + mix(self.marks)[self.lang])
        alive, every = np.zeros(len(own), bool), np.zeros(len(own), np.uint64)  # of the n-grams one word shorter, by the word at which they begin
        for n in range(1, longest + 1):
            if n > 1:
                at = np.flatnonzero(alive[:-1] & alive[1:])
                at = at[at + n <= len(own)]
                at = at[self.piece[at] == self.piece[at + n - 1]]
                hashes = mix(every[at] * np.uint64(0x9E3779B97F4A7C15) + own[at + n - 1])
            kept = survive(n, hashes)
            yield at, hashes, kept
            alive[:] = False
            alive[at[kept]], every[at] = True, hashes

    def counted(self, longest: int, survive) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        """For each length the languages, hashes, numbers and words of the different survivors."""
        whole, offset = self.words.joined()
        texts = pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(whole)) if len(self) else pa.array([], pa.large_string())
        word = pc.dictionary_encode(texts).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        different = int(word.max(initial=0)) + 1
        codes = self.lang.astype(np.int64)
        for n, (at, hashes, kept) in enumerate(self.levels(longest, survive), 1):
            at, hashes = at[kept], hashes[kept]
            # equal words before the last one, and equal last words
            code, names = pd.factorize(codes[at] * different + word[at + n - 1])
            first = np.zeros(len(names), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            codes = np.zeros(len(self), np.int64)
            codes[at] = code
            low = at[first]
            ends = zip(offset[low].tolist(), (offset[low + n] - 1).tolist(), strict=True)
            yield self.lang[low], hashes[first], np.bincount(code, minlength=len(names)), [whole[a:b] for a, b in ends]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, list[str]]]:
    """(chunk, its languages) from rows (lang, text)."""

    def chunk_of(parts: list[pa.RecordBatch]) -> Iterator[tuple[Chunk, list[str]]]:
        table = pa.Table.from_batches(parts).combine_chunks()
        names = table.column(0).combine_chunks().dictionary_encode()
        langs, numbers = names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        marks = np.array([xxh3_64_intdigest(x) for x in langs], np.uint64)
        for rows, data, offsets in byte_slices(table.column(1).combine_chunks(), CHUNK_BYTES):
            yield Chunk(data, offsets, numbers[rows], marks), langs

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield from chunk_of(held)
            held, size = [], 0
    if held:
        yield from chunk_of(held)


def _cells(hashes: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """The cell of each hash in each row."""
    for row in range(ROWS):
        yield (mix(hashes + np.uint64(row * 0x632BE59BD9B4E019 % (1 << 64))) & np.uint64(cells - 1)).astype(np.int64)


def _surviving(known: list[list[np.ndarray]], cells: int):
    """A function of a length and hashes: whether all cells of each reach the least frequency. All of a length that has no sketch yet do."""

    def survive(n: int, hashes: np.ndarray) -> np.ndarray:
        keep = np.ones(len(hashes), bool)
        for row, at in zip(known[n - 1], _cells(hashes, cells), strict=True) if n <= len(known) else ():
            keep &= row[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
        return keep

    return survive


def _sketched(n: int, bits, cells: int):
    """Rows (block, cells, counts) of this task's sketch of n-grams of n words whose shorter ones survive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ROWS, cells), np.int64)
        for chunk, _ in _chunks(batches):
            *_, (_, hashes, _) = chunk.levels(n, _surviving(bits.value, cells))
            for row, at in zip(total, _cells(hashes, cells), strict=True):
                np.add.at(row, at, 1)
        pack = zstandard.ZstdCompressor(level=1).compress
        for block, counts in enumerate(total.reshape(-1, BLOCK)):
            used = np.flatnonzero(counts)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(used.astype(np.uint16).tobytes())]), pa.array([pack(counts[used].tobytes())])], names=["block", "used", "counts"])

    return run


def _merged(least: int):
    """Partitions come sorted by block. Rows (block, bits) of the cells that reach the least frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        block, total = None, np.zeros(BLOCK, np.int64)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], names=["block", "bits"])

        for batch in batches:
            for own, used, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if own != block:
                    if block is not None:
                        yield flush()
                    block, total = own, np.zeros(BLOCK, np.int64)
                total[np.frombuffer(unpack(used), np.uint16)] += np.frombuffer(unpack(counts), np.int64)
        if block is not None:
            yield flush()

    return run


def surviving_cells(texts: DataFrame, longest: int, least: int, cells: int) -> list[list[np.ndarray]]:
    """For each length a bit for each cell of each row: whether the merged sketch has ``least`` there. ROWS * cells / 8 bytes for each length."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known: list[list[np.ndarray]] = []
    for n in range(1, longest + 1):
        sketch = texts.transform(map_arrow, _sketched(n, spark.sparkContext.broadcast(known), cells), "block int, used binary, counts binary")
        merged = sketch.repartition(parts, "block").sortWithinPartitions("block").transform(map_arrow, _merged(least), "block int, bits binary")
        bits = np.zeros((ROWS * cells // BLOCK, BLOCK // 8), np.uint8)
        for r in merged.collect():
            bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
        known.append(list(bits.reshape(ROWS, -1)))
    return known


def _exact(longest: int, bits, cells: int, buckets: int):
    """Rows (bucket, langs, phrases, counts), packed, of the survivors of a chunk; the empty phrase stands for all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for chunk, langs in _chunks(batches):
            have = np.unique(chunk.lang)
            found = [(have, chunk.marks[have], np.bincount(chunk.lang)[have], [b""] * len(have)), *chunk.counted(longest, _surviving(bits.value, cells))]
            lang, hashes, counts = (np.concatenate([x[k] for x in found]) for k in range(3))
            phrases = [p for x in found for p in x[3]]
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                mine = order[cuts[k] : cuts[k + 1]]
                rows.append((k, "\n".join([langs[x] for x in lang[mine].tolist()]).encode(), b"\n".join([phrases[i] for i in mine.tolist()]), counts[mine].astype(np.int64).tobytes()))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array([pack(x) for x in c], pa.binary()) for c in columns[1:])], names=["bucket", "langs", "phrases", "counts"])

    return run


def _added(least: int):
    """Partitions come sorted by bucket. Rows (lang, words, phrase, n) of phrases that occur ``least`` times, and of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        bucket: int | None = None
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            kept = [(lang, phrase.count(" ") + 1 if phrase else 0, phrase, n) for (lang, phrase), n in total.items() if n >= least or not phrase]
            columns = list(zip(*kept, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "words", "phrase", "n"])

        for batch in batches:
            for own, *packed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if own != bucket:
                    if total:
                        yield flush()
                    bucket, total = own, Counter()
                langs, phrases, counts = (unpack(x) for x in packed)
                for key, n in zip(zip(langs.decode().split("\n"), phrases.decode().split("\n"), strict=True), np.frombuffer(counts, np.int64).tolist(), strict=True):
                    total[key] += n
        if total:
            yield flush()

    return run


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100, text_col: str = "text", lang_col: str = "lang", cells: int = CELLS) -> DataFrame:
    """(lang, words, phrase, n): the phrases of up to ``longest`` words that occur at least ``least`` times in a language, with their exact number, and with words = 0 and an empty phrase the number of all words of each language that has some."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bits = spark.sparkContext.broadcast(surviving_cells(texts, longest, least, cells))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = texts.transform(map_arrow, _exact(longest, bits, cells, parts * BUCKETS), "bucket int, langs binary, phrases binary, counts binary")
    return materialise(packed.repartition(parts, "bucket").sortWithinPartitions("bucket").transform(map_arrow, _added(least), "lang string, words int, phrase string, n long"), "phrases")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, share: int = 100, best: int = 2000, text_col: str = "text", lang_col: str = "lang", cells: int = CELLS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the ``best`` phrases of 2 to ``longest`` words. a: its occurrences, n: all words of the language, l and r: the occurrences of the two parts
    of the cut with the lowest score, floor(1000 * a * n / (l * r)). Phrases that lie in a longer one that occurs at least ``share`` percent as often are left out."""
    counts = frequent_phrases(docs, longest, least, text_col, lang_col, cells)
    total = counts.where("words = 0").select("lang", F.col("n").alias("n"))
    phrases = counts.where("words > 0").select("lang", "words", "phrase", F.col("n").alias("a"))
    long = phrases.where("words > 1")
    split = F.split("phrase", " ")
    part = lambda low, size: F.array_join(F.slice(split, low, size), " ")

    # cuts, with the exact numbers of both parts
    cuts = long.select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of = lambda side, name: phrases.select(F.col("lang"), F.col("phrase").alias(side), F.col("a").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    above = (wide("a") * wide("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    cuts = cuts.withColumn("above", above.cast("decimal(38,0)")).withColumn("below", (wide("l") * wide("r")).cast("decimal(38,0)"))
    lowest = F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r", "n")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")

    # phrases within longer ones
    places = F.explode(F.expr("flatten(transform(sequence(2, words - 1), size -> transform(sequence(1, words - size + 1), at -> struct(at, size))))")).alias("place")
    inner = long.where("words > 2").select("lang", F.col("a").alias("outer"), split.alias("tokens"), places)
    inner = inner.select("lang", "outer", F.array_join(F.slice("tokens", F.col("place.at"), F.col("place.size")), " ").alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    free = scored.join(inner, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (F.lit(100) * F.col("outer") < F.lit(share) * F.col("a")))

    # the best of some tasks, then the best of these
    order = (F.desc("score"), F.desc("a"), "phrase")
    some = free.withColumn("dealt", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "dealt").orderBy(*order))).where(F.col("rank") <= best)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
