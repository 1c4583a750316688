"""Benchmark decontamination by one Aho-Corasick automaton over the words of all benchmark items.

Words are runs of ASCII letters and digits and of other characters outside ASCII, with A-Z lower-cased. A window is
``window`` consecutive words of an item, or all words of a shorter item. Of each item the automaton holds every
``block`` words, block being half a window, rounded up, so that each window has a whole block in it; a shorter item is held as it is. So
the automaton has about a state for each word of the items, not for each word of each window. A text is scanned once,
word by word, whatever the number of items; where a block is met, the words beside it are compared with the item's, and a run of a
window or more is hit. Offsets of hits are mapped back to characters of the text as it was.

Benchmark texts are collected only behind a check of their size: beyond ``BLOCK_BYTES`` they are dealt into parts, each with its own
automaton, and the texts are scanned once for each part, row by row and by the same steps, whatever the number of parts.

Defined cases: a null or empty text has no words and no hits; an item without words is never found; items with equal
ids count as one; an item with a null id hits words but is not listed; with no items, nothing is hit; rows with equal ids stay separate rows."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import fresh, materialise, ship, trim

#: Bytes of benchmark text in one automaton, about.
BLOCK_BYTES = 4 << 20
#: Surroundings of blocks whose outcome a task remembers.
MEMO = 1 << 14

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_NORMAL = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class WindowAutomaton:
    """Finds every occurrence of every window of the items."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        import ahocorasick

        self.window, self.block = window, (window + 1) // 2
        self.numbers: dict[bytes, int] = {}
        self.names: list[str | None] = []
        words, self.first = [], [0]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        #: Where a pattern occurs in the items, as places in their words: the first, and further ones.
        self.more: dict[int, list[int]] = {}
        for item, text in items:
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of((text or "").encode())]
            at = self.first[-1]
            step = self.block if len(own) >= window else max(1, len(own))
            for k in range(0, len(own) - step + 1, step):
                known = self.machine.get(key := tuple(own[k : k + step]), None)
                if known is None:
                    self.machine.add_word(key, at + k)
                else:
                    self.more.setdefault(known, []).append(at + k)
            words += own
            self.first.append(at + len(own))
            self.names.append(None if item is None else str(item))
        self.words = np.array(words, np.int32)
        self.empty = not words
        self.memo: dict[tuple, tuple[list[tuple[int, int]], list[str]]] = {}
        if not self.empty:
            self.machine.make_automaton()

    def _around(self, text: tuple[int, ...], at: int, pattern: int) -> tuple[list[tuple[int, int]], list[str]]:
        """The hit runs of words, and the items hit, by a pattern whose first word is text[at]."""
        runs, names = [], []
        for place in (pattern, *self.more.get(pattern, ())):
            item = bisect_right(self.first, place) - 1
            low, high = self.first[item], self.first[item + 1]
            length = min(self.window, high - low)
            begin, end = at, at + (self.block if length == self.window else length)
            q = place
            while begin > 0 and q > low and at - begin < self.window - 1 and text[begin - 1] == self.words[q - 1]:
                begin, q = begin - 1, q - 1
            q = place + end - at
            while end < len(text) and q < high and end - at < 2 * self.window and text[end] == self.words[q]:
                end, q = end + 1, q + 1
            if end - begin >= length:
                runs.append((begin - at, end - at))
                if self.names[item] is not None:
                    names.append(self.names[item])
        return _merged(runs), names

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(runs of hit words as [first, end), items whose windows occur)."""
        if self.empty or not words:
            return [], set()
        runs, items = [], set()
        get = self.numbers.get
        text = tuple([get(w, 0) for w in words])
        reach = 2 * self.window
        for last, pattern in self.machine.iter(text):
            place = int(pattern)
            item = bisect_right(self.first, place) - 1
            size = self.first[item + 1] - self.first[item]
            at = last + 1 - (self.block if size >= self.window else size)
            low = max(0, at - self.window)
            # many texts hold the same passages
            key = (place, text[low : at + reach], at - low)
            found = self.memo.get(key)
            if found is None:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                found = self.memo[key] = self._around(text[low : at + reach], at - low, place)
            runs += [(at + a, at + b) for a, b in found[0]]
            items.update(found[1])
        return _merged(runs), items


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _characters(text: bytes, runs: list[list[int]]) -> list[dict[str, int]]:
    """The runs as [start, end) in characters of the text."""
    places = [m.span() for m in _WORD.finditer(text.lower())]
    out, at, characters = [], 0, 0
    for a, b in runs:
        span = []
        for byte in (places[a][0], places[b - 1][1]):
            characters += len(text[at:byte].decode())
            at = byte
            span.append(characters)
        out.append({"start": span[0], "end": span[1]})
    return out


_SHAPE = "n_words long, n_hit long, items array<string>, runs array<struct<first:int,end:int>>, spans array<struct<start:int,end:int>>"


def _scan(items, window: int):
    """A function from texts, and what was found in them before, to what is found in all."""
    pair = lambda a, b: pa.list_(pa.struct([(a, pa.int32()), (b, pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pair("first", "end"), pair("start", "end")]
    names = ["n_words", "n_hit", "items", "runs", "spans"]

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        automaton = WindowAutomaton(items.value, window)
        try:
            for texts, *before in batches:
                rows = []
                for k in range(len(texts)):
                    text = (texts[k].as_py() or "").encode()
                    words = words_of(text)
                    runs, found = automaton.scan(words)
                    if before:
                        old = before[0][k].as_py()
                        runs, found = _merged([*runs, *((x["first"], x["end"]) for x in old["runs"])]), found | set(old["items"])
                    spans = _characters(text, runs) if runs else []
                    rows.append((len(words), sum(b - a for a, b in runs), sorted(found), [{"first": a, "end": b} for a, b in runs], spans))
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=names)
        finally:
            del automaton
            trim()

    return run


def with_contamination(docs: DataFrame, benchmark: DataFrame, name: str, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``name``: the number of words and of words inside an occurrence of a window, the sorted ids of
    items with occurring windows, and the hit passages as runs of words and as character offsets. Other columns stay as they are."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // block_bytes))
    out = docs
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        held = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in part.collect()])
        run, text = _scan(held, window), F.col(text_col).cast("string")
        if k:
            # parts are scanned one after the other, so that a worker holds one automaton at a time
            out = materialise(out, "hits")

            @F.arrow_udf(_SHAPE)
            def more(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
                yield from run(batches)  # noqa: B023

            out = out.withColumn(name, more(text, F.col(name)))
        else:

            @F.arrow_udf(_SHAPE)
            def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                yield from run((x,) for x in batches)  # noqa: B023

            out = out.withColumn(name, found(text))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of each row; see ``with_contamination``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = with_contamination(rows, benchmark, "found", window, **options)
    return found.select("doc_id", *(F.col(f"found.{x}").alias(x) for x in ("n_words", "n_hit", "items", "spans")))


def contaminated(n_hit="n_hit", n_words="n_words") -> F.Column:
    """A row is contaminated if a twentieth of its words or more are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated, with all their columns, whatever the names of these. A row with a null or empty text
    stays; an empty table, or a benchmark without words, leaves all rows as they are."""
    name = fresh(docs, "contamination")
    found = with_contamination(docs, benchmark, name, window, text_col, **options)
    return found.where(~contaminated(f"{name}.n_hit", f"{name}.n_words")).drop(name)
