"""The pipeline against a plain version of all its stages."""

import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import queries


def _hash(doc_id: int, text: str) -> int:
    h = xxhash.xxh64_intdigest(struct.pack("<i", 1), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), h)
    return xxhash.xxh64_intdigest(text.encode(), h) >> 1


def _mixed(docs: list[tuple[int, str, str]]) -> list[tuple[int, str]]:
    """Each document as often as the mix takes it, by sorting."""
    order = sorted({s for _, _, s in docs})
    size = {s: sum(len(t.split()) for _, t, x in docs if x == s) for s in order}
    weight = {s: [5.0, 2.0, 1.0][k % 3] for k, s in enumerate(order)}
    target, left, total = {}, set(order), float(sum(size.values()))
    while left:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s], total = 3.0 * size[s], total - 3 * size[s]
        left -= set(over)
    out = []
    for s in order:
        own = sorted(((_hash(i, t), len(t.split()), i, t) for i, t, x in docs if x == s))
        whole = min(3, int(target[s] // size[s]))
        out += [(i, t) for _, _, i, t in own] * whole
        budget, low, cap = (target[s] - whole * size[s] if whole < 3 else 0.0), -1, float("inf")
        for _ in range(4):
            fits = [x for x in own if x[0] >= low and x[1] <= cap]
            used, end = 0, None
            for h, n, i, t in fits if budget >= 1 else ():
                if used + n > budget:
                    end = h
                    break
                used += n
                out.append((i, t))
            if end is None:
                break
            budget, low = budget - used, end
            cap = budget
    return out


def test_pipeline_by_plain_python(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(11)
    say = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    toxic = {i for i in range(0, 600, 6)}
    rows = {i: say(rng.randint(20, 60)) + ["vileword", "nastyword"] * (4 * (i in toxic)) for i in range(600)}
    for i in range(1, 120, 6):  # near and exact copies
        near = list(rows[i])
        near[-1] = "changed"
        rows[700 + i], rows[900 + i] = near, list(rows[i])
    items = {k: say(30) for k in range(5)}
    for k in range(5):
        rows[1100 + k] = say(10) + items[k] + say(10)
    lang = {i: "en" for i in rows}
    source = {i: f"s{i % 4}" for i in rows}
    docs = [(i, " ".join(w), lang[i], source[i], len(" ".join(w))) for i, w in rows.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {i: w for i, w in rows.items() if "vileword" not in w}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in kept.items()}
    low = {i: i for i in kept}
    common = {}
    for i, own in sets.items():
        for x in own:
            common.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in common.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in range(10):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    kept = {i: w for i, w in kept.items() if low[i] == i}
    windows = {tuple(w[k : k + 13]) for w in items.values() for k in range(len(w) - 12)}
    hits = {i: len({x for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for x in range(k, k + 13)}) for i, w in kept.items()}
    kept = {i: w for i, w in kept.items() if not (hits[i] and 20 * hits[i] >= len(w))}
    assert len(rows) - len(kept) >= 100 + 40 + 5
    taken = sorted(_mixed([(i, " ".join(w), source[i]) for i, w in kept.items()]))
    tokenizer = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    want, start = [], 0
    for i, text in taken:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found.collect()) == want
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_return_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.where(F.lit(False)), str(tmp_path)).count() == 0
    assert len(corpus_pipeline.STAGES) == 5
