"""The monitor of runs: what a stream tells equals what a batch of the same lines tells."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming.metrics import DONE, FAILED
from tessera.streaming.monitor import PROVIDER, monitored

START = datetime(2026, 1, 1)


def log():
    """(run, minutes, value): runs that end well, fail, time out, end too late, do both, go on, and never begin."""
    rng = random.Random(4)
    rows = []
    ends = {"well": (4, DONE), "fails": (3, FAILED), "late": (12, DONE), "silent": (None, None), "open": (None, None)}
    for run, (end, mark) in ends.items():
        begin = 36 if run == "open" else rng.randint(0, 3)
        times = sorted(rng.uniform(0, end or 6) for _ in range(8))
        rows += [(run, begin + t, f"x METRICS prompt_tokens={k}") for k, t in enumerate(times)] + [(run, begin, "begins"), (run, begin + 0.5, None)]
        if mark:
            rows.append((run, begin + end, f"{mark} runs=8"))
    rows += [("both", 1, DONE), ("both", 1, FAILED), ("both", 2, DONE), ("both", 0.5, "METRICS a"), (None, 1, DONE), ("at once", 2, DONE), ("well", 6, "METRICS after"), ("clock", 45, "tick")]
    return rows


def lines_of(rows):
    return [{"run": r, "time": (START + timedelta(minutes=m)).isoformat() + "Z", "value": v} for r, m, v in rows]


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    yield
    spark.conf.set(key, old)


@pytest.mark.parametrize("files", [1, 6])
def test_stream_tells_what_the_batch_tells(spark, store, tmp_path, files):
    pytest.importorskip("google.protobuf")  # the state's protocol
    schema = "run string, time timestamp, value string"
    rows = sorted(log(), key=lambda r: r[1])
    rows += rows[3:9]  # a poll repeats lines
    folder = tmp_path / "in"
    folder.mkdir()
    own = sorted(lines_of(rows), key=lambda x: x["time"])
    size = -(-len(own) // files)
    for k in range(files):
        part = own[k * size : (k + 1) * size]
        random.Random(k).shuffle(part)
        (folder / f"{k}.json").write_text("\n".join(json.dumps(x) for x in part))
        os.utime(folder / f"{k}.json", (1_000_000 + k, 1_000_000 + k))  # the stream reads older files first
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    query = monitored(stream).writeStream.format("memory").queryName(f"told{files}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = monitored(spark.read.schema(schema).json(str(folder)))
    rows_of = lambda df: sorted(((r.run, r.kind, str(r.time), r.value or "", -1 if r.metrics is None else r.metrics) for r in df.collect()))
    told = rows_of(spark.table(f"told{files}"))
    assert told == rows_of(batch)
    ends = {r: (kind, n) for r, kind, _, _, n in told if kind != "metrics"}
    assert ends == {"well": ("done", 8), "fails": ("failed", 8), "late": ("timeout", ends["late"][1]), "silent": ("timeout", 8), "both": ("failed", 1), "at once": ("done", 0)}
    assert 5 <= ends["late"][1] <= 8 and len(told) == len(set(told)) == 5 * 8 + 2 + 6


def test_batches_of_odd_lines(spark):
    rows = spark.createDataFrame([("a", None, DONE), (None, START, DONE), ("b", START, None)], "run string, time timestamp, value string").withColumn("kind", F.lit(1)).withColumn("end", F.lit(2))
    assert monitored(rows).count() == 0 and monitored(rows.limit(0)).count() == 0
    more = rows.union(spark.createDataFrame([("c", START + timedelta(hours=1), "tick", 1, 2)], rows.schema))
    assert [(r.run, r.kind, r.time, r.metrics) for r in monitored(more).collect()] == [("b", "timeout", START + timedelta(minutes=10), 0)]
