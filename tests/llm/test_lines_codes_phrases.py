"""Lines, codes and phrases through their queries against plain Python, on odd tables too."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import codes, lines, phrases, queries
from tessera.llm.perfect_hash import PerfectHash

BLANKS = " \t\n\x0b\x0c\r"
CLASHES = ["chunk", "keys", "shard", "n", "last", "kept", "gone", "owner", "codes", "error", "of", "phrase", "words", "a", "l", "r", "rank", "score", "k"]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def write(spark, folder, name, rows, shape):
    frame = spark.createDataFrame(rows, shape)
    frame.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES)).repartition(5).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def line_rows(seed):
    rng = random.Random(seed)
    shared = [f"Shared line number {k} of the texts" for k in range(30)] + ["Ünïcode line of twenty", "x" * 19, "y" * 20, " \t" + "z" * 18 + " "]
    rows = [(i, "\n".join(rng.choice(shared + [f"own line {i} {k} that is long enough" for k in range(4)]) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    rows += [(1000 + i, "A line that a third of all documents hold\nand more " + str(i)) for i in range(150)]
    return rows + [(7, None), (7, rows[8][1]), (7, rows[8][1]), (8, ""), (None, shared[0]), (None, None), (9000, "\n".join(shared * 300)), (9001, "w" * 200_000)]


@pytest.mark.parametrize("chunk_keys", [lines.CHUNK_KEYS, 20])
def test_lines_by_plain_python(spark, tmp_path, monkeypatch, chunk_keys):
    monkeypatch.setattr(lines, "CHUNK_KEYS", chunk_keys)
    monkeypatch.setattr(lines, "SHARD_KEYS", min(chunk_keys * 5, lines.SHARD_KEYS))
    rows = line_rows(1)
    held, key = {}, lambda x: lower(x.strip(BLANKS))
    for r, (i, text) in enumerate(rows):
        for x in (text or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                held.setdefault(key(x), {})[r] = i
    want = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if i is None or len(held.get(key(x), ())) < 3 or max(held[key(x)].values()) == i]
        want.append((str(i), len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert sum(n for *_, n, _ in want) > 500
    found = queries.op11_line_dedup(spark, write(spark, tmp_path, "documents", rows, "doc_id long, text string"))
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in found.collect()) == sorted(want)


def test_lines_of_no_rows(spark, tmp_path):
    assert queries.op11_line_dedup(spark, write(spark, tmp_path / "none", "documents", [], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in lines.without_common_lines(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 1, 0, "")]


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 50_000):
        high, low = rng.integers(0, 1 << 63, (2, n)).astype(np.uint64)
        if n > 10:
            high[: n // 2] = high[0]  # keys that differ in one half only
        index, place = PerfectHash.of(high, low)
        assert sorted(place.tolist()) == list(range(n))
        again = PerfectHash.from_bytes(index.to_bytes())
        assert (again.places(high, low) == place).all()
        others = again.places(high + np.uint64(1), low)
        assert ((others >= -1) & (others < max(n, 1))).all()
        assert sum(map(len, index.levels)) <= 6 * n + 100


def vector_rows(seed, n=400, length=16):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(i % 5, 1) for _ in range(length)], i % 3 if i % 7 else None) for i in range(n)]
    rows += [(1000 + i, [0.25] * length, 1) for i in range(200)]
    return rows + [(3, [0.5] * length, 2), (3, [-0.5] * length, 2), (None, [1.0] * length, 0), (5000, None, 1), (5001, [None] + [1.0] * (length - 1), 1), (5002, [math.nan] * length, 1), (5003, [math.inf] * length, 1), (5004, [], 1), (5005, [1.0] * 5, 1), (5006, [0.0] * length, 1)]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    length = Counter(len(v) for _, v, _ in rows if v and len(v) % parts == 0).most_common(1)[0][0]
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) == length]
    width = length // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    books = [[cut(v)[p] for _, v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min((far(x, entry), e) for e, entry in enumerate(books[p]))
    for _ in range(rounds):
        mine = [[[] for _ in first] for _ in range(parts)]
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                mine[p][nearest(p, x)[1]].append(x)
        books = [[[sum(c) // len(own) for c in zip(*own, strict=True)] if own else books[p][e] for e, own in enumerate(mine[p])] for p in range(parts)]
    out = []
    for i, v, label in kept:
        near = [nearest(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), label))
    by_label = Counter()
    for *_, error, label in out:
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted((str(i), code, error, by_label[label], digest) for i, code, error, label in out)


@pytest.mark.parametrize(("n", "chunk"), [(400, codes.CHUNK), (400, 17), (5, codes.CHUNK)])
def test_codes_by_plain_python(spark, tmp_path, monkeypatch, n, chunk):
    monkeypatch.setattr(codes, "CHUNK", chunk)
    rows = vector_rows(3, n)[: None if n > 5 else 5]
    found = queries.op12_vector_codes(spark, write(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>, label int"))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    single = [(i, [None if x is None else float(np.float32(x)) for x in v] if v else v, label) for i, v, label in rows]
    assert sorted((str(r.vec_id), *r[1:]) for r in found.collect()) == plain_codes(single)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tessera_")]


def test_codes_of_no_vectors(spark, tmp_path):
    assert queries.op12_vector_codes(spark, write(spark, tmp_path, "embeddings", [(1, None, 1), (2, [], None)], "vec_id long, embedding array<float>, label int")).count() == 0
    with pytest.raises(Exception, match="too large"):
        codes.vector_codes(spark.createDataFrame([(1, [1e30] * 8, 1)], "vec_id long, embedding array<double>, label long"))


def test_code_rounds_do_not_shuffle_vectors(spark):
    rows = spark.createDataFrame([(k, [float(k % 13 + j) for j in range(8)], 1) for k in range(500)], "vec_id long, embedding array<double>, label long")
    n = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with codes._bucketed(spark) as bucketed:
            one = bucketed(rows.select(F.col("vec_id").alias("chunk"), "embedding"), "one")
            two = bucketed(rows.select(F.col("vec_id").alias("chunk"), "label"), "two")
            plan = one.join(two, "chunk")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", n)
    assert "Join" in plan and "Exchange" not in plan


def phrase_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "", ",", ". ", "\n", "\t"]) for _ in range(n))
    rows = [(i, say(rng.randint(0, 200)) + " New York City hall " * (i % 3), ["en", "de", None, "und"][i % 4]) for i in range(120)]
    rows += [(500 + i, "again and again: the very same passage of words; so what", "en") for i in range(120)]
    return rows + [(1900, None, "fr"), (901, "", "it"), (None, say(40), None), (902, "a a a a a a", "en"), (903, "b " * 30_000, "en"), (904, "É é 你好。 你好 c\x00d", "de")] + [(905, "same row here", "en")] * 40


def plain_phrases(rows, least, best):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            own = f.setdefault(lang, Counter())
            own.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = {q[i:j] for q, a in found.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and 100 * a >= 100 * counts[q[i:j]]}
        scored = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "best", "cells"), [(100, 2000, phrases.CELLS), (20, 7, phrases.BLOCK), (2, 50, phrases.BLOCK)])
def test_phrases_by_plain_python(spark, least, best, cells):
    rows = phrase_rows(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES)).repartition(3)
    got = phrases.collocations(docs, least=least, best=best, cells=cells)
    want = plain_phrases(rows, least, best)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and len(want) > 5
    assert sorted(tuple(r) for r in got.collect()) == want


def test_phrases_by_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 3000)
    rows = phrase_rows(5)
    got = queries.op13_collocations(spark, write(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string"))
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 100, 2000)
    assert queries.op13_collocations(spark, write(spark, tmp_path / "none", "documents", [], "doc_id long, text string, lang string")).count() == 0


def test_wide_scores_are_exact(spark, monkeypatch):
    counts = [("en", 0, "", 7 * 10**16), ("en", 1, "a", 3 * 10**15 + 1), ("en", 1, "b", 10**15 + 7), ("en", 2, "a b", 10**15 + 3)]
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: spark.createDataFrame(counts, "lang string, words int, phrase string, n long"))
    (r,) = phrases.collocations(spark.range(0)).collect()
    assert r.score == 1000 * (10**15 + 3) * 7 * 10**16 // ((3 * 10**15 + 1) * (10**15 + 7))
