"""Every operator against a plain version of it, on tables with nulls, empty and long texts, ties, repeated rows and ids, no rows, and columns of clashing names."""

import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import archives, queries
from tessera.llm.decontaminate import find_contamination, without_contaminated
from tessera.llm.mixture import mixed, with_copies
from tessera.llm.neighbours import nearest_neighbours
from tessera.llm.ngram_join import most_common, ngram_jaccard_components, one_of_each
from tessera.llm.quotes import reply_ordered
from tessera.llm.substrings import without_repeats
from tessera.llm.tokens import documents_through_files
from tessera.llm.toxicity import fit_toxicity, maximal_segments, not_toxic, score_toxicity
from tessera.llm.url_lists import listed_captures

WORD = r"[^\x20\x09-\x0d]+"
CLASHES = ["mix", "plan", "gone_id", "contamination", "tie", "before", "h", "n", "node", "component", "key", "size", "ranges", "covered_id", "file", "record", "found", "items"]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def odd_rows(seed=3):
    """Rows (id, text) of all kinds: null and repeated ids, equal rows, null, empty and very long texts."""
    rng = random.Random(seed)
    say = lambda n: " ".join(f"w{rng.randrange(120)}" for _ in range(n))
    long = say(60_000)
    one, two = say(40), say(40)
    rows = [(1, one), (1, one), (1, two), (2, one), (3, two), (4, f"{one} {two}"), (5, None), (6, ""), (7, " \n\t"), (8, "short"), (9, long), (10, long + " end"), (None, one), (None, None), (11, "éè \U0001f600 你好"), (12, "x" * 70_000)]
    return rows + [(20, say(30))] * 6


def odd(spark, rows=None):
    frame = spark.createDataFrame(odd_rows() if rows is None else rows, "doc_id long, text string")
    frame = frame.withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))))
    return frame.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))


def bench(spark, rows=((1, "w1 w2"), (None, "short"), (2, None), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def pages(df):
    return df.select(F.col("doc_id").alias("page_id"), F.lit("http://a/").alias("url"), F.col("text").alias("html"), *CLASHES)


OPERATORS = {
    "join": lambda s, d: ngram_jaccard_components(d, 4, 17, 20),
    "archives": lambda s, d: archives.pages_through_archives(pages(d)),
    "contamination": lambda s, d: find_contamination(d, bench(s)),
    "toxicity": lambda s, d: score_toxicity(d, fit_toxicity(d, s.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (99, 0)], "doc_id long, toxic int"))),
    "captures": lambda s, d: listed_captures(pages(d).withColumn("fetched", F.lit("2024-01-05")), s.createDataFrame([], "list string, domain string, day date, action string")),
    "mix": lambda s, d: with_copies(d, [5.0, 2.0, 1.0]),
    "repeats": lambda s, d: without_repeats(d, 13),
    "tokens": lambda s, d: documents_through_files(d, queries.tokenizer_path()),
    "quotes": lambda s, d: reply_ordered(d.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text", *CLASHES)),
}
STAGES = {
    "toxicity": lambda s, d: not_toxic(d, fit_toxicity(d, s.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))),
    "near copies": lambda s, d: one_of_each(d),
    "contamination": lambda s, d: without_contaminated(d, bench(s)),
    "mix": lambda s, d: mixed(d, [5.0, 2.0, 1.0]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_take_all_rows(spark, name):
    rows = OPERATORS[name](spark, odd(spark)).collect()
    wanted = len(odd_rows()) if name != "captures" else len({i for i, _ in odd_rows()})
    assert len(rows) == wanted
    assert OPERATORS[name](spark, odd(spark, [])).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, name):
    docs = odd(spark)
    found = STAGES[name](spark, docs)
    assert found.columns == docs.columns and all(r[c] == f"own {c}" for r in found.collect() for c in CLASHES)
    assert STAGES[name](spark, odd(spark, [])).count() == 0


def test_stages_keep_rows_without_text(spark):
    texts = lambda name: sorted((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in STAGES[name](spark, odd(spark)).select("doc_id", "text").collect())
    key = lambda rows: sorted((i is not None, i or 0, t is not None, t or "") for i, t in rows)
    assert texts("toxicity") == key(odd_rows())
    assert texts("contamination") == key([r for r in odd_rows() if r[1] not in ("short",)])
    gone = {i for i in (2, 10)}
    assert {i for i, _ in odd_rows() if i} - {r[1] for r in texts("near copies") if r[0]} >= gone


def test_join_on_odd_rows(spark):
    sets = {}
    for i, text in odd_rows():
        w = re.findall(WORD, lower(text))
        own = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(own)
    link = lambda a, b: any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b])
    ids = sorted(i for i in sets if i is not None)
    low = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if link(a, b):
                    low[a] = low[b] = min(low[a], low[b])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_components(odd(spark), 4, 17, 20).collect()), key=str)
    want = []
    for i, text in odd_rows():
        w = re.findall(WORD, lower(text))
        want.append((i, len({tuple(w[k : k + 4]) for k in range(len(w) - 3)}) or int(bool(w)), low.get(i)))
    assert got == sorted(want, key=str)


def test_join_of_a_large_group(spark):
    """More near copies than are tried or compared together, so that every path joins them."""
    rng = random.Random(5)
    base = [f"b{rng.randrange(10_000)}" for _ in range(60)]
    rows = []
    for i in range(700):
        own = list(base)
        own[rng.randrange(60)] = f"c{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"d{rng.randrange(10_000)}" for _ in range(50))) for i in range(100)]
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in (t.split() for _, t in rows)]
    ids, parent = [i for i, _ in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if find(a) != find(b) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: r.component_id for r in ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 17, 20).collect()}
    assert got == {i: ids[find(k)] for k, i in enumerate(ids)}


def test_most_common_is_bounded(spark):
    rows = spark.range(5000).select(F.col("id").alias("shingle"), (F.col("id") * F.col("id")).alias("n"))
    assert most_common(rows, 10_000).count() == 5000
    some = [r.shingle for r in most_common(rows, 700).collect()]
    assert 600 <= len(some) <= 700 and min(some) == 5000 - len(some)


def test_archives_by_plain_python(spark):
    rows = [*((i, t) for i, t in odd_rows()), (30, "a"), (31, "a"), (32, "b")]
    want = []
    last = {}
    for i, t in rows:
        last[t or ""] = max(last.get(t or "", -1), -1 if i is None else i)
    for i, t in rows:
        data = (t or "").encode()
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), None if (i if i is not None else -1) == last[t or ""] else last[t or ""]))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in archives.pages_through_archives(pages(odd(spark, rows)), version=2).collect()]
    # of repeated ids one is the response
    drop = lambda x: sorted({(str(i), n, d) for i, n, d, _ in x})
    assert drop(got) == drop(want)
    single = {i for i, _ in rows if i is not None and [k for k, _ in rows].count(i) == 1}
    assert {x for x in got if x[0] in single} == {x for x in want if x[0] in single}


def test_archives_of_other_records(spark, tmp_path):
    date, name = "20240131235959", "x"
    block = archives.arc_version_block(name, 1, date)
    dns = b"20240131235959\na.com.\t60\tIN\tA\t1.2.3.4\n"
    record = lambda url, kind, content: f"{url} 1.2.3.4 {date} {kind} {len(content)}\n".encode() + content + b"\n"
    page = b"HTTP/1.1 200 OK\r\nX-Page-Id: 5\r\n\r\nhello"
    parts = [block, record("dns:a.com", "text/dns", dns), record("dns:b.com", "text/dns", dns), record("http://a.com/", "text/html; charset=utf-8", page), record("http://b.com/", "text/html", page.replace(b": 5", b": 6"))]
    folder = tmp_path / "arc"
    folder.mkdir()
    (folder / "part-0.txt").write_bytes(b"".join(archives._member(p) for p in parts))
    archives.convert_arc(spark, str(folder), str(tmp_path / "warc"))
    got = sorted((r.record_type, r.page_id or 0, r.payload_bytes, r.payload_digest) for r in archives.read_warc(spark, str(tmp_path / "warc")).collect())
    sha = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    assert got == sorted([("resource", 0, len(dns), sha(dns))] * 2 + [("response", 6, 5, sha(b"hello")), ("revisit", 5, 5, sha(b"hello"))])


@pytest.mark.parametrize(("seed", "block_bytes"), [(1, 1 << 20), (2, 400), (3, 1 << 20)])
def test_contamination_by_plain_python(spark, seed, block_bytes):
    rng = random.Random(seed)
    say = lambda n: [rng.choice("ab") if seed == 3 else f"v{rng.randrange(9)}" for _ in range(n)]
    items = {i: say(rng.choice([1, 3, 7, 12, 13, 14, 30])) for i in range(25)}
    texts = []
    for i in range(80):
        words = say(rng.randrange(60))
        if i % 2:
            own = items[rng.randrange(25)]
            begin = rng.randrange(len(own))
            words[len(words) // 2 : len(words) // 2] = own[begin : begin + rng.randrange(1, 31)]
        texts.append((i, " ".join(words)))
    for window in (13, 4):
        want = {}
        windows = {i: {tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1))} for i, w in items.items()}
        for i, text in texts:
            words, hit, found = text.split(), set(), set()
            for item, own in windows.items():
                for w in own:
                    for k in range(len(words) - len(w) + 1):
                        if tuple(words[k : k + len(w)]) == w:
                            hit |= set(range(k, k + len(w)))
                            found.add(str(item))
            want[i] = (len(words), len(hit), sorted(found))
        benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        got = find_contamination(docs, benchmark, window, block_bytes=block_bytes).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in got} == want
        by_id = dict(texts)
        assert all(sum(len(by_id[r.doc_id][s.start : s.end].split()) for s in r.spans) == r.n_hit for r in got)
        kept = {r.doc_id for r in without_contaminated(docs, benchmark, window, block_bytes=block_bytes).collect()}
        assert kept == {i for i, (n, h, _) in want.items() if not (h > 0 and 20 * h >= n)}


def test_segments_by_plain_search():
    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.0, -0.5, 1.0, 2.5]) for _ in range(rng.randint(1, 30))]

        def best(a, b):
            parts = [(sum(scores[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            if not parts or max(parts)[0] <= 0:
                return []
            total, _, i, j = max(parts)
            return [*best(a, i), (i, j, pytest.approx(total)), *best(j, b)]

        hits = [(k, s) for k, s in enumerate(scores) if s > 0]
        costs = [-sum(scores[(hits[k - 1][0] + 1 if k else 0) : at]) for k, (at, _) in enumerate(hits)]
        assert maximal_segments(hits, costs) == best(0, len(scores))


def test_segments_take_linear_time():
    for hits, least in (([(10 * k, 5.0) for k in range(20_000)], 20_000), ([(k * k, 100.0 + k) for k in range(20_000)], 19_000), ([(2 * k, 5.0) for k in range(20_000)], 1)):
        began = time.process_time()
        assert len(maximal_segments(hits, 1.0)) >= least
        assert time.process_time() - began < 1


def test_mix_by_plain_python(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30))) for i in range(400)] + [(1000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, "a").otherwise("b"))
    got = with_copies(docs, [5.0, 2.0, 1.0]).select("doc_id", "source", "mix.*").collect()
    size = {i: len((t or "").split()) for i, t in rows}
    source = {i: None if i % 5 == 0 else "a" if i % 5 == 1 else "b" for i, _ in rows}
    order = [*sorted({s for s in source.values() if s}), None]
    have = {s: sum(n for i, n in size.items() if source[i] == s) for s in order}
    weight, target, left, total = dict(zip(order, [5.0, 2.0, 1.0], strict=True)), {}, set(order), float(sum(size.values()))
    while left:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * have[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * have[s]
            total -= 3 * have[s]
            left.discard(s)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == have[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.copies <= 3
    for s in order:
        assert 0 <= target[s] - sum(r["size"] * r.copies for r in got if r.source == s) < 30
    again = with_copies(docs.repartition(7), [5.0, 2.0, 1.0]).select("doc_id", "mix.copies").collect()
    assert {(r.doc_id, r.copies) for r in again} == {(r.doc_id, r.copies) for r in got}


def test_mix_of_equal_rows(spark):
    rows = [(1, "w " * 10, "a")] * 300 + [(k, "w " * 10, "b") for k in range(2, 302)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = with_copies(docs, [2.0, 5.0]).groupBy("source").agg(F.sum(F.col("mix.size") * F.col("mix.copies")).alias("taken"), F.first("mix.target").alias("target"), F.count("*").alias("n")).collect()
    assert all(r.n == 300 and 0 <= r.target - r.taken < 10 for r in got)


def test_repeats_of_repeated_ids(spark):
    rows = odd_rows() + [(40, " ".join(f"q{k}" for k in range(20))), (40, " ".join(f"w{k}" for k in range(20))), (39, " ".join(f"q{k}" for k in range(15)))]
    words = [(i, re.findall(WORD, t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    want = []
    for i, w in words:
        gone = set() if i is None else {x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for x in range(k, k + 13)}
        want.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in without_repeats(odd(spark, rows)).collect()]
    assert sorted(got) == sorted(want)


def test_token_files_of_odd_rows(spark):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, text in odd_rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((str(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = documents_through_files(odd(spark), queries.tokenizer_path(), file_ids=50_000).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got][:2] == [None, None] and [r.doc_id for r in got][2:] == sorted(i for i, _ in odd_rows() if i is not None)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]


def test_neighbours_of_repeated_ids(spark):
    rows = [(100, [1.0, 0.0])] * 20 + [(i, [1.0, 0.0]) for i in (101, 102, 103, 104, 105)] + [(7, [0.5, 0.5]), (7, [0.0, 9.0]), (None, [1.0, 0.0]), (8, None), (9, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("kind", F.lit(1)).withColumn("part", F.lit(2))
    got = nearest_neighbours(frame, 3, 100).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(100, 1, 101), (100, 2, 102), (100, 3, 103)]
    got = nearest_neighbours(frame, 10, 100).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [101, 102, 103, 104, 105, 7]
    assert nearest_neighbours(frame.limit(0), 3, 100).count() == 0
