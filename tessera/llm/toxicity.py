"""Toxicity by maximum-scoring segments.

Words are counted in toxic and in other labelled texts, once for each text that holds them. Tokens, which are whole words and beginnings of words, get their log-odds
ratio between the two under an informative Dirichlet prior with the frequencies of the whole; a token counts if its
signed root of the likelihood ratio is large. A word's score is that of the whole word less a margin, or, if that does not count, of the most telling
of its beginnings, so that ordinary text scores below nought on average. A whole word that does not count by itself but whose counts
contradict its beginnings keeps its own ratio. Runs of scripts that are written without blanks, and runs of more than LONG bytes, are read as
overlapping windows, one from each character on, in place of words. The scan of Ruzzo and Tompa over the words' own scores finds all maximal segments of a
text in linear time. Their scores are calibrated by the extreme-value law of Karlin and Altschul: lambda solves sum p exp(lambda s) = 1 over
all occurrences of words in texts that are not toxic, K fits how often such texts have any segment, and a segment in a text of n words has
lambda S - ln(K n) nats of evidence. Evidence of the significant segments is summed up, and a logistic curve over it gives the score. These three are
fitted on the labelled texts in FOLDS parts, by the hash of the id, each scored by weights learned from the other parts; the weights in use are learned from all.

A model is learned from at most MOST_LABELS labels, the only bound. All tokens that count are kept: at a z of LEAST_Z a token must be in several labelled
texts, so their number is bounded by what these hold, whatever the size of the corpus. Else only histograms of fixed length reach the driver.

Defined cases: a null or empty text has no words and scores as a text without segments; rows with a null label or id
are not learned from; a label for an id that has no text is ignored, one for an id with several rows counts for each, and repeated labels count repeatedly; without
toxic or without other labels no token counts and all texts score alike; rows with equal ids stay separate rows; columns besides the named ones are left alone."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import hash_sample, map_arrow, materialise, ship

#: Labelled rows from which a model is learned, at most.
MOST_LABELS = 1 << 16
#: A token counts beyond this root of its likelihood-ratio statistic.
LEAST_Z = 5.0
#: Pseudo-counts of the Dirichlet prior altogether.
PRIOR = 1000.0
#: What a word must exceed on the log-odds scale to add to a segment.
MARGIN = 2.5
#: Bytes of the longest beginning that is a token, and of a window, which is filled up to a whole character.
PREFIX = 8
#: Bytes of the shortest beginning that is a token.
LEAST_PREFIX = 4
#: Bytes of the longest run that is read as one word.
LONG = 64
#: Words whose scores a worker remembers.
MEMO = 1 << 17
#: Parts of the labelled texts, each of which calibrates weights learned from the others.
FOLDS = 4
#: Bins of the histograms and the largest value that they tell apart.
BINS, MOST_EVIDENCE = 400, 200.0

_NORMAL = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Characters of scripts without blanks: Thai and Lao, Myanmar, Khmer, kana, Han, half-width kana.
_CHAR = rb"(?:\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|\xe3\x80[\x85-\x87]|\xe3[\x81-\x83\x90-\xbf][\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2}|\xef[\xa4-\xab\xbd\xbe][\x80-\xbf]|\xf0[\xa0-\xbf][\x80-\xbf]{2})"
_UNSPACED = re.compile(_CHAR)
_WORD = re.compile(rb"[^ ]+")
_RUN = re.compile(rb"(" + _CHAR + rb"+)|(?:(?!" + _CHAR + rb")[^ ])+")


def _windows(run: bytes) -> Iterator[tuple[int, int]]:
    """Spans from each character on, the last ones left out that are shorter than a token; together they cover the run."""
    for begin in range(len(run)):
        if run[begin] & 0xC0 == 0x80:
            continue
        if begin and len(run) - begin < LEAST_PREFIX:
            break
        end = min(begin + PREFIX, len(run))
        while end < len(run) and run[end] & 0xC0 == 0x80:
            end += 1
        yield begin, end


def places_of(text: bytes) -> list[tuple[int, int]]:
    """The spans of the words and windows of a text, in bytes."""
    plain = text.translate(_NORMAL)
    spaced = text.isascii() or not _UNSPACED.search(plain)
    out = []
    for m in (_WORD if spaced else _RUN).finditer(plain):
        at, end = m.span()
        if end - at > LONG or not spaced and m[1]:
            out += [(at + a, at + b) for a, b in _windows(m[0])]
        else:
            out.append((at, end))
    return out


def words_of(text: bytes) -> list[bytes]:
    plain = text.translate(_NORMAL)
    words = plain.split()
    if words and (max(map(len, words)) > LONG or not text.isascii() and _UNSPACED.search(plain)):
        return [plain[a:b] for a, b in places_of(text)]
    return words


def beginnings(word: bytes) -> list[bytes]:
    return [word[:n] for n in range(LEAST_PREFIX, min(len(word), PREFIX) + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, fold, clean, toxic): in how many texts a word is; summed within the task as far as memory allows."""
    held = [(Counter(), Counter()) for _ in range(FOLDS)]

    def flush() -> Iterator[pa.RecordBatch]:
        for fold, (clean, toxic) in enumerate(held):
            keys = list(clean.keys() | toxic.keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([fold] * len(keys), pa.int32()), *(pa.array([x[k] for k in keys], pa.int64()) for x in (clean, toxic))], names=["word", "fold", "clean", "toxic"])
            clean.clear()
            toxic.clear()

    for batch in batches:
        for text, toxic, n, fold in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            own = set(words_of((text.as_py() or "").encode()))
            held[fold][toxic].update(own if n == 1 else dict.fromkeys(own, n))
            if sum(len(x) + len(y) for x, y in held) > MEMO:
                yield from flush()
    yield from flush()


def maximal_segments(hits: list[tuple[int, float]], gap: float | list[float]) -> list[tuple[int, int, float]]:
    """(first, end, score) of all maximal-scoring segments. hits: places and scores above nought, in order; every other place
    scores ``-gap``, or ``gap`` has for each hit what the places since the one before cost together. The algorithm of Ruzzo
    and Tompa, with stretches between hits as one step."""
    out: list[list] = []  # first, end, cumulative score before, cumulative score after
    lower: list[int] = []  # of each, the last one before it with a smaller score before; those between are never looked at again
    total, place = 0.0, 0
    for k, (at, score) in enumerate(hits):
        total -= gap[k] if isinstance(gap, list) else gap * (at - place)
        first, before, after = at, total, total + score
        total += score
        place = at + 1
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= before:
                j = lower[j]
            if j < 0 or out[j][3] >= after:
                break
            first, before = out[j][0], out[j][2]
            up = lower[j]
            del out[j:], lower[j:]
            j = up
        out.append([first, at + 1, before, after])
        lower.append(j)
    return [(a, b, after - before) for a, b, before, after in out]


@dataclass
class ToxicityModel:
    weights: dict[bytes, float] = field(default_factory=dict)
    margin: float = MARGIN
    scale: float = 1.0  # lambda
    k: float = 1.0
    slope: float = 0.0
    offset: float = -2.0  # with nothing learned no text is called toxic

    def backed_off(self, word: bytes) -> float | None:
        """The ratio of the most telling beginning: the largest above nought, else the smallest below; None if none counts."""
        found = [self.weights[t] for t in beginnings(word) if t in self.weights]
        if not found:
            return None
        return most if (most := max(found)) > 0 else min(found)

    def word_score(self, word: bytes) -> float:
        """The whole word decides, else its beginnings."""
        own = self.weights.get(word + b"$")
        return (own if own is not None else self.backed_off(word) or 0.0) - self.margin

    def scores(self, words: list[bytes], memo: dict[bytes, float]) -> np.ndarray:
        for w in words:
            if w not in memo:
                if len(memo) > MEMO:
                    memo.clear()
                memo[w] = self.word_score(w)
        try:
            return np.fromiter((memo[w] for w in words), np.float64, len(words))
        except KeyError:  # the memo was emptied meanwhile
            return np.array([self.word_score(w) for w in words])

    def segments(self, words: list[bytes], memo: dict[bytes, float]) -> list[tuple[int, int, float]]:
        scores = self.scores(words, memo)
        above = np.flatnonzero(scores > 0)
        if not len(above):
            return []
        costs = np.diff(np.cumsum(np.maximum(-scores, 0.0))[above], prepend=0.0)
        return maximal_segments(list(zip(above.tolist(), scores[above].tolist(), strict=True)), costs.tolist())

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Nats of the significant segments: those of which chance gives less than one."""
        floor = math.log(self.k * max(n, 1))
        return sum(max(0.0, self.scale * s - floor) for _, _, s in segments)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(60.0, max(-60.0, self.slope * math.log1p(evidence) + self.offset))))


def _segment_rows(model, passages: bool):
    """model: a broadcast model, or a list of models of which the key, modulo their number, names one."""
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: list[ToxicityModel] = model.value if isinstance(model.value, list) else [model.value]
        memos: list[dict[bytes, float]] = [{} for _ in models]
        for batch in batches:
            which = (np.zeros(batch.num_rows, int) if len(models) == 1 else batch.column(0).to_numpy() % len(models)).tolist()
            sizes, most, scores, spans, rates = [], [], [], [], []
            for k, value in zip(which, batch.column(1), strict=True):
                own, text = models[k], (value.as_py() or "").encode()
                words = words_of(text)
                found = own.segments(words, memos[k])
                evidence = own.evidence(found, len(words))
                sizes.append(len(words))
                most.append(max((s for _, _, s in found), default=0.0))
                scores.append(evidence)
                if passages:
                    floor = math.log(own.k * max(len(words), 1))
                    rates.append(own.score(evidence))
                    spans.append(_passages(text, [(a, b, own.scale * s - floor) for a, b, s in found if own.scale * s > floor]))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(most, pa.float64()), pa.array(scores, pa.float64())]
            names = ["key", "n_words", "most", "evidence"]
            if passages:
                columns += [pa.array(rates, pa.float64()), pa.array(spans, kinds)]
                names += ["score", "passages"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _passages(text: bytes, segments: list[tuple[int, int, float]]) -> list[dict]:
    if not segments:
        return []
    places = places_of(text)
    out, at, characters = [], 0, 0
    for a, b, evidence in segments:
        span = []
        for byte in (places[a][0], places[b - 1][1]):
            # windows overlap, so a passage may begin before the end of the one before
            characters += len(text[at:byte].decode()) if byte >= at else -len(text[byte:at].decode())
            at = byte
            span.append(characters)
        out.append({"start": span[0], "end": span[1], "evidence": evidence})
    return out


def _solved_scale(values: np.ndarray, counts: np.ndarray) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1; the mean is below nought and some value above."""
    p = counts / counts.sum()
    low, high = 1e-6, 1.0
    total = lambda x: float(np.sum(p * np.exp(np.minimum(600, x * values))))
    while total(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1 else (low, middle)
    return (low + high) / 2


def _logistic(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Slope, not below nought, and offset of the likeliest logistic curve, the targets smoothed as Platt has them. Newton's steps are halved until the
    likelihood grows, as with few rows they may lead astray."""
    nt, nc = toxic.sum(), clean.sum()
    high, low = (nt + 1) / (nt + 2), 1 / (nc + 2)
    yes, all_ = toxic * high + clean * low, toxic + clean

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float(np.sum(all_ * np.logaddexp(0, z) - yes * z) + 5e-3 * a * a)

    a, b = 0.0, math.log((nt + 1) / (nc + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        g = yes - all_ * p
        w = all_ * p * (1 - p) + 1e-9
        h = np.array([[np.sum(w * x * x) + 1e-2, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-3]])
        step = np.linalg.solve(h, np.array([np.sum(g * x) - 1e-2 * a, np.sum(g)]))
        while loss(max(0.0, a + step[0]), b + step[1]) > loss(a, b) and np.abs(step).max() > 1e-9:
            step = step / 2
        a, b = max(0.0, a + step[0]), b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labels: int = MOST_LABELS) -> ToxicityModel:
    """Learn from the rows of ``labels`` (0 or 1) that have a text; of more than ``most_labels`` different ones from those with the smallest hashes."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("toxic")).where("label_id is not null and toxic in (0, 1)")
    known = known.groupBy("label_id", "toxic").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(F.lit(11), "label_id"))
    # a table of at most most_labels rows of numbers, which every executor can hold
    known = F.broadcast(hash_sample(known, "h", most_labels))
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text"))
    # the texts are read once
    learn = materialise(texts.join(known, "label_id").select("text", "toxic", "n", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    counts = learn.select("text", "toxic", "n", "fold").transform(map_arrow, _counts, "word binary, fold int, clean long, toxic long")
    # without each fold, and last of all
    part = lambda c, f: F.sum(F.col(c)) - (F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)) if f < FOLDS else 0)
    counted = counts.groupBy("word").agg(*(part(c, f).alias(f"{c}{f}") for c in ("clean", "toxic") for f in range(FOLDS + 1)))
    *others, weights = _weights(materialise(counted, "words"), FOLDS + 1)
    model = ToxicityModel(weights)
    if model.weights:
        _calibrate(model, [ToxicityModel(x) for x in others], learn)
    return model


def _weights(counted: DataFrame, models: int) -> list[dict[bytes, float]]:
    """The log-odds ratios of the tokens that count in each model k, from words with their numbers of clean and of toxic texts (clean_k, toxic_k)."""
    names = [f"{c}{k}" for k in range(models) for c in ("clean", "toxic")]
    totals = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first()
    usable = [k for k in range(models) if totals[f"clean{k}"] and totals[f"toxic{k}"]]
    if not usable:
        return [{} for _ in range(models)]
    # a word's tokens: all of it with an end mark, and its beginnings
    size = F.length("word")
    starts = F.when(size >= LEAST_PREFIX, F.transform(F.sequence(F.lit(LEAST_PREFIX), F.least(size, F.lit(PREFIX))), lambda n: F.substring(F.col("word"), F.lit(1), n))).otherwise(F.array().cast("array<binary>"))
    every = F.concat(F.array(F.concat("word", F.lit("$").cast("binary"))), starts)
    per_token = counted.select(F.explode(every).alias("token"), *names).groupBy("token").agg(*(F.sum(c).alias(c) for c in names))
    ratios, strong = [], []
    for k in usable:
        clean, toxic = totals[f"clean{k}"], totals[f"toxic{k}"]
        c, t = F.col(f"clean{k}"), F.col(f"toxic{k}")
        alpha = PRIOR * (c + t) / (clean + toxic)
        x, y = t + alpha, c + alpha
        ratio = F.log(x / (toxic + PRIOR - x)) - F.log(y / (clean + PRIOR - y))
        gain = lambda n, of: F.when(n > 0, n * F.log(n * (clean + toxic) / ((c + t) * of))).otherwise(0.0)  # noqa: B023, E731
        z = F.sqrt(2 * F.greatest(F.lit(0.0), gain(c, clean) + gain(t, toxic)))
        ratios.append(F.when((c + t > 0) & (z > LEAST_Z), ratio).alias(f"r{k}"))
        strong.append(F.col(f"r{k}").isNotNull())
    rows = per_token.select("token", *ratios).where(reduce(lambda a, b: a | b, strong)).collect()
    found = [{bytes(r["token"]): r[f"r{k}"] for r in rows if r[f"r{k}"] is not None} if k in usable else {} for k in range(models)]
    for more, own in zip(_exceptions(found, counted, totals), found, strict=True):
        own |= more
    return found


def _exceptions(found: list[dict[bytes, float]], counted: DataFrame, totals) -> list[dict[bytes, float]]:
    """For each model the ratios of whole words that do not count by themselves and whose counts contradict their beginnings."""
    held = counted.sparkSession.sparkContext.broadcast([(ToxicityModel(x), totals[f"clean{k}"], totals[f"toxic{k}"]) for k, x in enumerate(found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            words, *numbers = (batch.column(k).to_pylist() for k in range(batch.num_columns))
            for word, *counts in zip(words, *numbers, strict=True):
                for k, (own, clean, toxic) in enumerate(held.value):
                    c, t = counts[2 * k : 2 * k + 2]
                    if not own.weights or word + b"$" in own.weights or c + t < 2 or (ratio := own.backed_off(word)) is None:
                        continue
                    share = 1 / (1 + clean / toxic * math.exp(-ratio))
                    z = math.sqrt(2 * max(0.0, sum(x * math.log(x / ((c + t) * p)) for x, p in ((t, share), (c, 1 - share)) if x)))
                    if z > LEAST_Z:
                        alpha = PRIOR * (c + t) / (clean + toxic)
                        x, y = t + alpha, c + alpha
                        rows.append((k, word + b"$", math.log(x / (toxic + PRIOR - x)) - math.log(y / (clean + PRIOR - y))))
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int32(), pa.binary(), pa.float64()), strict=True)], names=["model", "token", "ratio"])

    last = len(found) - 1
    # a single text contradicts nothing
    often = counted.where(F.col(f"clean{last}") + F.col(f"toxic{last}") >= 2).select("word", *(f"{c}{k}" for k in range(len(found)) for c in ("clean", "toxic")))
    out: list[dict[bytes, float]] = [{} for _ in found]
    for r in often.transform(map_arrow, run, "model int, token binary, ratio double").collect():
        out[r["model"]][bytes(r["token"])] = r["ratio"]
    return out


def _calibrate(model: ToxicityModel, others: list[ToxicityModel], learn: DataFrame) -> None:
    """Fit lambda, K and the curve on labelled texts (text, toxic, n, fold); others: for each fold a model that was learned without it."""
    spark = learn.sparkSession
    held = spark.sparkContext.broadcast(others)
    steps = np.linspace(-30, 30, BINS)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, memos = np.zeros(BINS + 1, np.int64), [{} for _ in held.value]
        for batch in batches:
            for text, n, fold in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2)), strict=True):
                scores = held.value[fold].scores(words_of((text.as_py() or "").encode()), memos[fold])
                sums += n * np.bincount(np.searchsorted(steps, scores), minlength=BINS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS + 1)), pa.array(sums)], names=["bin", "n"])

    found = learn.where("toxic = 0").select("text", "n", "fold").transform(map_arrow, scored, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BINS + 1)
    for r in found:
        counts[r["bin"]] = r["n"]
    values = np.append(steps, steps[-1])
    # one more word at the highest score, as by the prior, so that lambda exists without any such word
    most = max(model.weights.values(), default=0.0) - model.margin
    if most <= 0:
        return
    counts[np.searchsorted(steps, most)] += 1

    def use(scale: float, k: float):
        for x in (model, *others):
            x.scale, x.k = scale, k
        return spark.sparkContext.broadcast(others)

    held_now = use(_solved_scale(values, counts), model.k)
    # a key holds how often a text counts, its label, and its fold
    asked = learn.select(((2 * F.col("n") + F.col("toxic")) * FOLDS + F.col("fold")).alias("key"), "text")
    shape = "key long, n_words long, most double, evidence double"
    label, often = F.floor(F.col("key") / FOLDS) % 2, F.floor(F.col("key") / (2 * FOLDS))
    rows = asked.where(label == 0).transform(map_arrow, _segment_rows(held_now, False), shape).where("n_words > 0")
    hit = rows.agg(F.sum(often), F.sum(F.when(F.col("most") > 0, often)), F.sum(often * F.col("n_words")) / F.sum(often)).first()
    # P(some segment of at least the least score above nought) = 1 - exp(-K n exp(-lambda s))
    share = ((hit[1] or 0) + 1) / ((hit[0] or 0) + 2)
    least = max(0.1, float(np.median([w - model.margin for w in model.weights.values() if w > model.margin] or [1.0])) / 2)
    held_now = use(model.scale, min(1.0, max(1e-9, -math.log(1 - share) / max(1.0, hit[2] or 1.0) * math.exp(min(50.0, model.scale * least)))))
    rows = asked.transform(map_arrow, _segment_rows(held_now, False), shape)
    bin_of = F.least(F.lit(BINS - 1), F.floor(F.log1p("evidence") * (BINS / math.log1p(MOST_EVIDENCE * 10)))).cast("int")
    table = rows.groupBy(bin_of.alias("bin"), label.alias("label")).agg(F.sum(often).alias("n")).collect()
    toxic, other = np.zeros(BINS), np.zeros(BINS)
    for r in table:
        (toxic if r["label"] == 1 else other)[r["bin"]] = r["n"]
    x = (np.arange(BINS) + 0.5) * math.log1p(MOST_EVIDENCE * 10) / BINS
    x[0] = 0.0
    model.slope, model.offset = _logistic(x, toxic, other)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, score, passages) of each row: the score from 0 to 1 and the significant passages as character offsets."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    shape = "key long, n_words long, most double, evidence double, score double, passages array<struct<start:int,end:int,evidence:double>>"
    found = rows.transform(map_arrow, _segment_rows(held, True), shape)
    return found.select(F.col("key").alias("doc_id"), "n_words", "score", "passages")


def not_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, whatever the names of these. A null or empty text scores as a text
    without segments; an empty table stays empty; equal rows are kept or dropped alike."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    run = _segment_rows(held, False)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        found = next(run(iter([pa.RecordBatch.from_arrays([text, text], names=["key", "text"])])))
        return pa.array([held.value.score(x) for x in found.column(3).to_pylist()], pa.float64())

    return docs.where(score(F.col(text_col).cast("string")) < threshold)


def is_held_out(id_col: str) -> F.Column:
    """Rows kept from learning: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
