import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import archives, queries
from tessera.llm.decontaminate import find_contamination, without_contaminated
from tessera.llm.mixture import with_copies
from tessera.llm.neighbours import nearest_neighbours
from tessera.llm.ngram_join import ngram_jaccard_components, one_of_each
from tessera.llm.quotes import reply_ordered
from tessera.llm.substrings import without_repeats
from tessera.llm.tokens import documents_through_files
from tessera.llm.toxicity import fit_toxicity, maximal_segments, score_toxicity
from tessera.llm.url_lists import listed_captures

WORD = r"[^\x20\x09-\x0d]+"


def corpus(n=60, seed=1):
    """Texts with copies, near copies, a common passage, short, empty and null ones, and an extra column of a clashing name."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 200))) for _ in range(n)]
    for i in range(0, n, 5):
        words = texts[i].split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
        texts.append(texts[i].upper() if i % 2 else texts[i])
    texts = [f"{t} {passage}" if k % 3 == 0 else t for k, t in enumerate(texts)]
    return [*enumerate(texts), (900, ""), (901, None), (902, " \t\n"), (903, "two words"), (904, "two words")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("n", F.lit(0)).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))))


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize(("words", "num", "den"), [(4, 17, 20), (5, 4, 5)])
def test_ngram_join(spark, words, num, den):
    rows = corpus()
    sets = {}
    for i, text in rows:
        w = re.findall(WORD, lower(text))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_components(frame(spark, rows), words, num, den).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    assert one_of_each(frame(spark, rows), words=words, num=num, den=den).count() == len({find(i) for i in sets})
    assert ngram_jaccard_components(frame(spark, []), words, num, den).count() == 0


def test_archives(spark):
    rows = [(1, "http://a/ b", "x" * 5000), (2, None, None), (3, "http://c/", ""), (4, "http://d/", "x" * 5000), (5, "http://é/", "é\r\n\r\n\0")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1))
    for version in (1, 2):
        got = {r.page_id: r for r in archives.pages_through_archives(pages, version=version).collect()}
        assert {i: got[i].payload_bytes for i in got} == {i: len((h or "").encode()) for i, _, h in rows}
        assert all(got[i].payload_digest == archives.digest((h or "").encode()) for i, _, h in rows)
        assert {i: (got[i].record_type, got[i].refers_to) for i in got} == {1: ("revisit", 4), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None)}


def test_decontamination(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = frame(spark, [(1, f"Before, {item.upper()}! after"), (2, "clean words"), (3, None), (4, "tiny Item here")])
    bench = spark.createDataFrame([(7, item), (8, "tiny item"), (9, "?"), (None, "clean words")], "item_id long, text string")
    for block in (1 << 20, 60):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in find_contamination(docs, bench, block_bytes=block).collect()}
        assert got == {1: (22, 20, ["7"]), 2: (2, 2, []), 3: (0, 0, []), 4: (3, 2, ["8"])}
    span = find_contamination(docs, bench).where("doc_id = 1").first().spans[0]
    assert f"Before, {item.upper()}! after"[span.start : span.end] == item.upper()
    assert [r.doc_id for r in without_contaminated(docs, bench).collect()] == [3]


def test_toxicity(spark):
    rng = random.Random(2)
    rows = [(i, " ".join([f"w{rng.randrange(200)}" for _ in range(60)] + ["awful", "nasty"] * (3 * (i % 4 == 0)))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(5000, 1), (1, None)], "doc_id long, toxic int")
    docs = frame(spark, [*rows, (998, None), (999, "")])
    got = {r.doc_id: r for r in score_toxicity(docs, fit_toxicity(docs, labels)).collect()}
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i, _ in rows) and got[998].score == got[999].score < 0.5
    span = got[0].passages[0]
    assert "awful" in rows[0][1][span.start : span.end]
    assert fit_toxicity(docs, labels.where("toxic = 0")).weights == {}
    assert maximal_segments([(0, 2.0), (1, 2.0), (50, 3.0)], 1.0) == [(0, 2, 4.0), (50, 51, 3.0)]


def test_mixture(spark):
    rows = [(i, " ".join("w" * (1 + i % 9))) for i in range(300)] + [(900, None)]
    got = with_copies(frame(spark, rows), [5.0, 2.0, 1.0]).select("doc_id", "source", "mix.*").collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 3 for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r["size"] * r.copies for r in own) - own[0].target) <= 9
        assert own[0].source_size == sum(r["size"] for r in own)


def test_substrings(spark):
    rows = corpus()
    words = {i: re.findall(WORD, t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    got = {r.doc_id: r for r in without_repeats(frame(spark, rows)).collect()}
    for i, w in words.items():
        gone = {x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for x in range(k, k + 13)}
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))


def test_token_files(spark):
    tokenizers = pytest.importorskip("tokenizers")
    rows = [*corpus(20), (-3, "a  b\n\n c.d, É x ' 's"), (5, "again")]
    tokenizer = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    got = sorted(documents_through_files(frame(spark, rows), queries.tokenizer_path(), file_ids=3000).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    wanted = [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, text in rows for ids in [[*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]]]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(wanted)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(800, 8)).round(1)
    vectors[100:160] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] * 8), (1150, [1.0])]
    got = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, 50).collect()
    hits = 0
    for q in range(0, 800, 50):
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(800), d)) if i != q][:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        hits += len({r.vec_id for r in own} & set(want))
        assert [r.rank for r in own] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-12 for r in own)
    assert hits >= 0.9 * 160 and {r.query_id for r in got} == set(range(0, 800, 50))


def test_url_lists(spark):
    captures = spark.createDataFrame([(1, "http://u@A.b.com:8/x", "2024-02-01"), (2, "http://b.com", "2024-04-01"), (3, None, "2024-02-01"), (4, "http://b.com", None)], "page_id long, url string, fetched string")
    entries = spark.createDataFrame([("l", "b.com", "2024-01-01", "add"), ("l", "b.com", "2024-03-01", "remove"), ("m", "a.b.com", "2024-02-01", "add")], "list string, domain string, day string, action string").withColumn("day", F.to_date("day"))
    got = {r.page_id: (r.listed, r.lists) for r in listed_captures(captures, entries).collect()}
    assert got == {1: (True, ["l", "m"]), 2: (False, []), 3: (False, []), 4: (False, [])}


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there\n\nHow are you?"), (1, 1, "assistant", "> How are you?\nFine."), (1, 2, "user", "> > How are you?\n> Fine.\nGood"), (1, 3, "user", None), (None, 0, "user", "> x"), (2, 0, "user", "> How are you?\nNo")]
    got = {(r.conv_id, r.turn): r for r in reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, t].reply_to for t in range(4)] == [None, 0, 1, None] and got[1, 2].thread == 0 and got[1, 2].depth == 2
    assert got[1, 1].content == "Fine." and got[1, 2].sources == [0, 1] and got[2, 0].reply_to is None and got[1, 3].content == ""


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, " ".join(f"d{i}x{k}" for k in range(40))) for i in range(30)] + [(100, " ".join(f"d3x{k}" for k in range(40)))]
    frame(spark, rows).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [i for i in range(30) if i != 5]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
