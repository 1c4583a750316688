"""N-gram Jaccard self-join of texts by an R-tree over count vectors.

The shingles of a text are hashed; their hash also deals them into groups, and the text becomes the point of its group
counts. The sum over groups of the smaller count bounds the overlap of two sets from above, so an R-tree over the
points finds all partners of a text without looking at most others; surviving pairs are verified on the sets.

One tree over a whole corpus would not prune, as a point's radius grows with its size, so the points are first dealt
into blocks, by groups too and without losing a link: sets of like size that differ in at most d elements, dealt into more than d
groups, agree in some group altogether. A text's keys are the contents of its groups. Texts that share a key
are joined where the bound on their points allows a link, so what forms a block is alike, directly or over others. Shingles that many texts hold are left out of the groups, which keeps a common passage
from joining blocks; texts of little else have keys with them, too. A large block is split into tiles
of pairs of chunks. Each block or tile has its own tree.

Shingles are told apart by hashes of 64 bits and whole sets by digests of 128 bits; texts are not compared word by word.

Defined cases: a null or empty text, or one without words, has no shingles and no links; a text of fewer words than
a shingle is one shingle; texts with equal sets are linked; rows with the same id are one node; a row with a null id keeps
a null component; an empty table gives no rows. Columns besides the id and the text are left alone, whatever their names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.rtree import CountRTree, count_vectors, group_number, overlap
from tessera.llm.wordhash import mix, text_slices
from tessera.session import fresh, map_arrow, materialise, ship

#: Shingles that a task looks at together, in memory.
CHUNK = 1 << 20
#: A task reports a shingle that so many different sets of its chunk hold; of all reported, so many count as common.
COMMON, MOST_COMMON = 3, 1 << 18
#: Bits of a common shingle's place in the table of them.
PLACE = 21
#: Texts that share a key up to which each two are tried as a pair, and up to which they are compared together. A group of
#: which a chunk alone has more than LOCAL, which is a large part of all texts, is joined without comparing.
FEW, TOGETHER, LOCAL = 8, 4096, 256
#: Buckets of keys for each shuffle partition.
BUCKETS = 2
#: Tasks to which the keys of one group of like texts are dealt.
DEALT = 16
#: A tile's chunk has so many sets or so many shingles, or a 32nd of its block.
TILE_SETS, TILE_SHINGLES, MOST_CHUNKS = 128, 1 << 21, 32


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, sorted distinct shingle hashes of each) of some rows at a time."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for part in text_slices(batch.column(1), lower=True):
            shingles, edge = part.windows(part.hashes(), words, short=True)
            yield ids[part.rows], [np.unique(shingles[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _common(words: int):
    """Rows (shingle, n) of shingles that several different sets of a chunk hold."""

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        values = np.sort(np.concatenate(held))
        cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        counts = np.diff(cuts, append=len(values))
        keep = counts >= COMMON
        return pa.RecordBatch.from_arrays([pa.array(values[cuts[keep]].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0
        for _, sets in _sets(batches, words):
            for own in sets:
                # the sum tells equal sets apart from others well enough for counting
                if len(own) and (mark := int(own.sum())) not in seen:
                    seen.add(mark)
                    held.append(own)
                    size += len(own)
            if size >= CHUNK:
                yield frequent(held)
                seen, held, size = set(), [], 0
        if held:
            yield frequent(held)

    return run


def common_table(common: list[int]) -> np.ndarray:
    """The common shingles at their places; where two share a place the first stays."""
    table = np.zeros(1 << PLACE, np.uint64)
    values = np.array(common[::-1], np.uint64)
    table[(values >> np.uint64(64 - PLACE)).astype(np.int64)] = values
    return table


class Levels:
    """Ranges of set sizes. A link's smaller set lies in some level, the larger in that or the next; ``groups`` of a level exceed
    by ``slack`` + 1 the ``apart`` elements in which such sets may differ."""

    def __init__(self, num: int, den: int):
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(-(-3 * lows[-1] // 2), den * lows[-1] // num + 1))
        self.lows = np.array(lows)
        smaller = self.lows[1:] - 1
        self.most = den * smaller // num  # of the larger set
        self.apart = (den - num) * (smaller + self.most) // (num + den)
        self.slack = np.where(self.apart > 0, self.apart // 3 + 1, 0)
        self.groups = self.apart + 1 + self.slack

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, level) of each level in which a set of each size may have a partner."""
        level = np.searchsorted(self.lows, sizes, "right") - 1
        rows = np.flatnonzero(sizes > 0)
        before = rows[(level[rows] > 0) & (sizes[rows] <= self.most[level[rows] - 1])]
        return np.concatenate([rows, before]), np.concatenate([level[rows], level[before] - 1])


def group_keys(sets: list[np.ndarray], levels: Levels, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the keys of each set."""
    sizes = np.array([len(x) for x in sets])
    row, level = levels.of(sizes)
    if not len(row):
        return row, np.zeros(0, np.uint64)

    def keys(jobs: np.ndarray, rare: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(job, key) and the number of empty groups of each job"""
        values = np.concatenate([sets[i] for i in row[jobs]])
        job = np.repeat(jobs, sizes[row[jobs]])
        if rare:
            keep = table[(values >> np.uint64(64 - PLACE)).astype(np.int64)] != values
            values, job = values[keep], job[keep]
        mixed = mix(values)
        group = (mixed >> np.uint64(32)) * levels.groups[level[job]].astype(np.uint64) >> np.uint64(32)
        place = job.astype(np.uint64) << np.uint64(32) | group
        order = np.argsort(place, kind="stable")
        place, mixed = place[order], mixed[order]
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])
        sums = np.add.reduceat(mixed, begin) if len(begin) else mixed
        own = job[order][begin]
        salt = (level[own].astype(np.uint64) * np.uint64(2) + np.uint64(rare)) << np.uint64(32) | place[begin] & np.uint64(0xFFFFFFFF)
        empty = levels.groups[level] - np.bincount(own, minlength=len(row))
        return own, mix(sums + mix(salt)), empty

    own, found, empty = keys(np.arange(len(row)), True)
    # where all groups in which two sets must agree may be empty ones, the common shingles are dealt, too
    weak = np.flatnonzero(empty > levels.slack[level])
    if len(weak):
        also, more, bare = keys(weak, False)
        own, found = np.concatenate([own, also]), np.concatenate([found, more])
        hollow = weak[bare[weak] > levels.slack[level[weak]]]
        own, found = np.concatenate([own, hollow]), np.concatenate([found, mix(level[hollow].astype(np.uint64) + np.uint64(1 << 62))])
    return row[own], found


_FIELDS = ["bucket", "first", "second", "third", "fourth"]
_SHAPE = "bucket int, first binary, second binary, third binary, fourth binary"


class _Groups:
    """Entries (key, node) in order of key and node; for each entry its group's first node and number of entries."""

    def __init__(self, keys: np.ndarray, nodes: np.ndarray, joined: np.ndarray | None = None, most: int = TOGETHER):
        order = np.lexsort((nodes, keys))
        self.keys, self.nodes = keys[order], nodes[order]
        self.lead = np.concatenate([[True], self.keys[1:] != self.keys[:-1]])[: len(keys)]
        self.begin = np.flatnonzero(self.lead)
        self.sizes = np.diff(self.begin, append=len(keys))
        self.size = np.repeat(self.sizes, self.sizes)
        self.first = np.repeat(self.nodes[self.begin], self.sizes)
        # groups of which a member stands for others are large, whatever their size
        marks = np.add.reduceat(joined[order], self.begin) > 0 if joined is not None and len(keys) else np.zeros(len(self.begin), bool)
        self.many = (self.size > most) | np.repeat(marks, self.sizes)
        self.some = ~self.many & (self.size > FEW)

    def tried(self) -> tuple[np.ndarray, np.ndarray]:
        """Each two different nodes of the small groups."""
        found = [np.zeros((2, 0), np.int64)]
        last = np.repeat(self.begin + self.sizes, self.sizes)
        place = np.arange(len(self.keys))
        for step in range(1, FEW):
            a = np.flatnonzero((self.size <= FEW) & ~self.many & (place + step < last))
            found.append(np.stack([self.nodes[a], self.nodes[a + step]]))
        return _pairs(*np.concatenate(found, axis=1))


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = a != b
    both = np.unique(np.stack([a[apart], b[apart]]), axis=1)
    return both[0], both[1]


def _point(shingles: np.ndarray) -> bytes:
    """The count vector with a byte for each group; nothing if a count needs more."""
    counts = count_vectors([shingles], group_number(len(shingles)))[0] if len(shingles) else np.zeros(0, np.int32)
    return counts.astype(np.uint8).tobytes() if len(counts) and counts.max() < 256 else b""


def _keyed(words: int, num: int, den: int, table, buckets: int):
    """Buckets of keys with the ids that have them; of many in the chunk only the first travels, marked. A bucket below -buckets holds rows
    (id, size, digest, point), one from -buckets to -1 pairs of ids of the chunk of which the second is such a first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(num, den)
        pack = zstandard.ZstdCompressor(level=1).compress
        keys, nodes, held, salt = [], [], 0, 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array([pack(x) for x in c], pa.binary()) for c in columns[1:])], names=_FIELDS)

        def flush() -> Iterator[pa.RecordBatch]:
            g = _Groups(np.concatenate(keys), np.concatenate(nodes), most=LOCAL)
            a, b = _pairs(g.nodes[g.many], g.first[g.many])
            rows = [(-1 - salt % buckets, a.tobytes(), b.tobytes(), b"", b"")] if len(a) else []
            keep = g.lead | ~g.many
            key, node, joined = g.keys[keep], g.nodes[keep], g.many[keep].astype(np.uint8)
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                mine = order[cuts[k] : cuts[k + 1]]
                rows.append((int(k), key[mine].tobytes(), node[mine].tobytes(), joined[mine].tobytes(), b""))
            if rows:
                yield batch_of(rows)

        for ids, sets in _sets(batches, words):
            sizes = np.array([len(x) for x in sets])
            salt += len(ids) + int(sizes.sum())
            known = np.array([x is not None for x in ids])
            doc = np.array([x if x is not None else 0 for x in ids], np.int64)
            digests = b"".join([_digest(x) for x in sets])
            points = [_point(x) for x in sets]
            lengths = np.array([len(x) for x in points], np.int64)
            yield batch_of([(-1 - buckets - salt % buckets, np.stack([doc, known]).tobytes(), np.stack([sizes, lengths]).tobytes(), digests, b"".join(points))])
            row, key = group_keys([x if k else x[:0] for x, k in zip(sets, known, strict=True)], levels, table.value)
            keys.append(key)
            nodes.append(doc[row])
            held += len(key)
            if held >= CHUNK // 2:
                yield from flush()
                keys, nodes, held = [], [], 0
        if held:
            yield from flush()

    return run


def _shared(buckets: int):
    """Partitions come sorted by bucket. Rows (0, a, b) of ids to be joined, (1, a, b) to be tried, (2, a, n, digest, point) of all texts,
    and (3, key, b, first id of the key) of ids to be compared together."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("point", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        bucket: int | None = None
        held: list[tuple[np.ndarray, ...]] = []

        def edges(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
            rest = [pa.nulls(len(a), pa.int64()) if n is None else pa.array(n), *(pa.nulls(len(a), pa.binary()) for _ in range(2))]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), *rest], schema=schema)

        def flush() -> Iterator[pa.RecordBatch]:
            g = _Groups(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield edges(0, *_pairs(g.nodes[g.many], g.first[g.many]))
            yield edges(1, *g.tried())
            yield edges(3, g.keys[g.some].view(np.int64), g.nodes[g.some], g.first[g.some])

        for batch in batches:
            for i in range(batch.num_rows):
                k = batch.column(0)[i].as_py()
                one, two, three, four = (unpack(batch.column(c)[i].as_py()) for c in (1, 2, 3, 4))
                if k < -buckets:
                    doc, known = np.frombuffer(one, np.int64).reshape(2, -1)
                    sizes, lengths = np.frombuffer(two, np.int64).reshape(2, -1)
                    ends = np.cumsum(lengths).tolist()
                    points = [four[y - x : y] for x, y in zip(lengths.tolist(), ends, strict=True)]
                    digests = [three[j : j + 16] for j in range(0, len(three), 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), 2, np.int32)), pa.array(doc, mask=known == 0), pa.nulls(len(doc), pa.int64()), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(points, pa.binary())], schema=schema)
                elif k < 0:
                    yield edges(0, np.frombuffer(one, np.int64), np.frombuffer(two, np.int64))
                else:
                    if k != bucket:
                        if held:
                            yield from flush()
                        bucket, held = k, []
                    held.append((np.frombuffer(one, np.uint64), np.frombuffer(two, np.int64), np.frombuffer(three, np.uint8).astype(np.int64)))
        if held:
            yield from flush()

    return run


def _possible(num: int, den: int):
    """Rows (a, b, n, m, p, q) of ids, sizes and points: the pairs whose bound on the overlap allows a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, p, q in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                fits = num * max(n, m) <= den * min(n, m)
                if fits and p and q:
                    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (p, q))
                    least = min(len(x), len(y))
                    bound = int(np.minimum(x.reshape(-1, least).sum(0), y.reshape(-1, least).sum(0)).sum())
                    fits = bound * (num + den) >= num * (n + m)
                keep.append(fits)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def joined_by_bound(points: list[bytes], sizes: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs that join those places whose bound allows a link, directly or over others. What is joined is compared only with what is not
    yet, so a group of alike texts takes a pass or two."""
    width = min((len(p) for p in points if p), default=1)
    # a text without a point may be like any
    matrix = np.stack([np.frombuffer(p, np.uint8).reshape(-1, width).sum(0, dtype=np.int32) if p else np.full(width, 1 << 20, np.int32) for p in points])
    rest = np.arange(len(points))
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            found = np.full(len(rest), -1)
            for x in range(0, len(front), 64):
                for y in range(0, len(rest), 64):
                    a, b = front[x : x + 64], rest[y : y + 64]
                    bound = np.minimum(matrix[a][:, None], matrix[b][None]).sum(2)
                    small, large = np.minimum.outer(sizes[a], sizes[b]), np.maximum.outer(sizes[a], sizes[b])
                    fits = (bound * (num + den) >= num * (small + large)) & (num * large <= den * small)
                    hit = fits.any(0)
                    found[y : y + 64][hit] = a[fits.argmax(0)[hit]]
            new = found >= 0
            yield from zip(found[new].tolist(), rest[new].tolist(), strict=True)
            front, rest = rest[new], rest[~new]


def _compared(num: int, den: int):
    """Partitions come sorted by the first id of a key, and key; rows (first, key, node, n, point). Pairs that join nodes, of which keys with the same
    first id give no more than it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, parent = None, [], {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def flush() -> pa.RecordBatch:
            nodes, sizes, points = zip(*held, strict=True)
            pairs = []
            if len({find(x) for x in nodes}) > 1:
                for i, j in joined_by_bound(list(points), np.array(sizes), num, den):
                    if (x := find(nodes[i])) != (y := find(nodes[j])):
                        parent[x] = y
                        pairs.append((nodes[i], nodes[j]))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for first, k, node, n, point in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if (first, k) != key:
                    if held:
                        yield flush()
                        if first != key[0]:
                            parent.clear()
                    key, held = (first, k), []
                held.append((node, n, point))
        if held:
            yield flush()

    return run


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for _, sets in _sets(iter([batch]), words) for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(found, pa.binary())], names=["doc_id", "block", "chunk", "chunks", "shingles"])

    return run


def join_block(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links within a block that join its components. side: 0 or 1, of a tile of two chunks, between which links are sought; 0
    everywhere if within one. Two texts that are joined over others already are not compared."""
    sizes = np.array([len(s) for s in sets])
    points = count_vectors(sets, group_number(int(sizes.max())))
    cross = side.any()
    inner = np.flatnonzero(side == side.max())
    tree = CountRTree(points[inner], sizes[inner])
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in np.flatnonzero(side == 0) if cross else range(len(ids)):
        mine, own = find(i), sets[i]
        for j in inner[tree.search(points[i], sizes[i], num, den)]:
            if (not cross and j <= i) or (other := find(j)) == mine:
                continue
            both = overlap(own, sets[j])
            if den * both >= num * (sizes[i] + sizes[j] - both):
                parent[other] = mine
                yield int(ids[i]), int(ids[j])


def _join_tiles(num: int, den: int):
    """Partitions come sorted by block and tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, sides = None, [], [], []

        def flush() -> pa.RecordBatch:
            pairs = list(join_block(np.array(ids), sets, np.array(sides), num, den)) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for block, i, j, side, doc, shingles in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if key != (block, i, j):
                    if ids:
                        yield flush()
                    key, ids, sets, sides = (block, i, j), [], [], []
                ids.append(doc)
                sets.append(np.frombuffer(shingles, np.uint64))
                sides.append(side)
        if ids:
            yield flush()

    return run


def most_common(reported: DataFrame, most: int) -> DataFrame:
    """The rows of ``reported`` (shingle, n) with the largest n, at most ``most``: rows are counted by n in a histogram of some thousand bins, and the bins
    taken from above as long as they fit. No rows are sorted."""
    n = F.col("n").cast("double")
    of = F.when(n < 1024, n).otherwise(1024 + F.floor(F.log2(n / 1024) * 64)).cast("int")
    left, least = most, None
    for r in sorted(reported.groupBy(of.alias("bin")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["bin"]):
        if r["rows"] > left:
            break
        left, least = left - r["rows"], r["bin"]
    return reported.where(of >= least) if least is not None else reported.limit(0)


def ngram_jaccard_components(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts are linked when |A & B| / |A | B| >= num / den for their sets of distinct ``words``-word shingles of
    lower-cased words. Returns (doc_id, n_shingles, component_id) for every row."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    reported = texts.transform(map_arrow, _common(words), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    # at most MOST_COMMON numbers reach the driver; which they are changes only the blocks, not the links
    top = most_common(materialise(reported, "common"), MOST_COMMON).orderBy(F.desc("n"), "shingle").select("shingle").toPandas()["shingle"]
    table = spark.sparkContext.broadcast(common_table([x % (1 << 64) for x in top.tolist()]))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = texts.transform(map_arrow, _keyed(words, num, den, table, n * BUCKETS), _SHAPE)
    found = materialise(keyed.repartition(n, "bucket").sortWithinPartitions("bucket").transform(map_arrow, _shared(n * BUCKETS), "kind int, a long, b long, n long, digest binary, point binary"), "keys")
    marks = found.where("kind = 2").select(F.col("a").alias("doc_id"), "n", "digest")
    points = found.where("kind = 2 and a is not null").select("a", "n", "point").dropDuplicates(["a", "n", "point"])
    tried = found.where("kind = 1").select("a", "b").distinct().join(points.select("a", "n", F.col("point").alias("p")).hint("shuffle_hash"), "a")
    tried = tried.join(points.select(F.col("a").alias("b"), F.col("n").alias("m"), F.col("point").alias("q")).hint("shuffle_hash"), "b").select("a", "b", "n", "m", "p", "q")
    together = found.where("kind = 3").select(F.col("n").alias("first"), F.col("a").alias("key"), F.col("b").alias("a")).join(points.hint("shuffle_hash"), "a")
    # keys of one group of copies have few first ids, and meet in some tasks that each join the group once
    together = together.select("first", "key", "a", "n", "point").repartition(n, "first", F.pmod("key", F.lit(DEALT)))
    compared = together.sortWithinPartitions("first", "key", "a").transform(map_arrow, _compared(num, den), "a long, b long")
    shared = found.where("kind = 0").select("a", "b").union(tried.transform(map_arrow, _possible(num, den), "a long, b long")).union(compared)
    blocks = materialise(connected_components(shared), "blocks")

    # one row for each different set of a block; equal sets are linked as they are
    members = marks.where("n > 0 and doc_id is not null").select("doc_id", "n", "digest").join(blocks, F.col("doc_id") == F.col("node")).select("doc_id", "n", "digest", F.col("component").alias("block"))
    kinds = materialise(members.groupBy("block", "digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "kinds")
    equal = members.join(kinds.select("block", "digest", "rep"), ["block", "digest"]).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    shape = kinds.groupBy("block").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    wanted = F.greatest(F.least(F.lit(MOST_CHUNKS), F.ceil(F.col("sets") / TILE_SETS)), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    todo = kinds.join(shape.select("block", wanted.alias("chunks")), "block").select("rep", "block", F.pmod(F.xxhash64("digest"), "chunks").cast("int").alias("chunk"), "chunks")

    # dealt out alike at every size: the texts once, the blocks' ids as the side that is held
    rows = texts.join(todo.hint("shuffle_hash"), F.col("doc_id") == F.col("rep")).select("doc_id", "text", "block", "chunk", "chunks")
    sets = rows.transform(map_arrow, _set_rows(words), "doc_id long, block long, chunk int, chunks int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tiles = sets.withColumn("other", other).select("block", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "doc_id", "shingles")
    links = tiles.repartition(n, "block", "i", "j").sortWithinPartitions("block", "i", "j", "doc_id").transform(map_arrow, _join_tiles(num, den), "a long, b long")
    joined = connected_components(equal.union(links))
    return marks.select("doc_id", F.col("n").alias("n_shingles")).join(joined, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever the names of these, without those near-copies of which the group has a smaller id. Rows with
    a null id or without words stay; rows with equal ids are kept or dropped together; an empty table stays empty."""
    id_col = options.get("id_col", "doc_id")
    groups = ngram_jaccard_components(docs, **options)
    name = fresh(docs, "gone_id")
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
