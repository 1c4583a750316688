"""The source of JSON lines against Python's own file and JSON readers; batches through lost tasks and killed runs."""

import io
import json
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.sources import jsonl as J
from tessera.sources import readers as I


def plain(data: bytes):
    """Lines as Python's text files have them."""
    return list(io.TextIOWrapper(io.BytesIO(data), encoding="utf-8"))


def test_ranges_of_lines():
    rng = random.Random(1)
    for _ in range(400):
        data = "".join(rng.choice(["a", "é", "\n", "\r", "\r\n", "bcd", ""]) for _ in range(rng.randrange(30))).encode()
        want = [x.rstrip("\n").encode() for x in plain(data)]
        for size in (1, 2, 3, 7, 100):
            stream = pa.BufferReader(data)
            got = [x for a in range(0, len(data), size) for x in J.lines_from(stream, a, min(a + size, len(data)), block=rng.choice([1, 2, 5, 1000]))]
            assert got == want, (data, size)


ODD = ['{"a": 1}', "", "\t", "   ", '{"a": 1, "a": 2}', '{"a": NaN}', '{"a": -Infinity}', "{bad", "[1]", "3", "null", ' {"a": 4}\x0b', "﻿{}", '{"a": "x\ty"}', '{"b": {"c": [1, null]}}', "{}", "{'a': 1}", '{"a": 1} x', "[" * 5000]


@pytest.mark.parametrize("range_bytes", [29, 1 << 20])
def test_lines_as_python_takes_them(spark, tmp_path, range_bytes):
    rng = random.Random(2)
    files = {}
    for name in ("a.jsonl", "b.jsonl", "empty.jsonl"):
        own = [rng.choice(ODD) for _ in range(0 if name == "empty.jsonl" else 60)]
        data = "".join(x + rng.choice(["\n", "\r\n", "\r"]) for x in own).encode() + (b'{"a": 9}' if name == "b.jsonl" else b"")
        files[name] = data
        (tmp_path / name).write_bytes(data)
    (tmp_path / "_hidden").write_text("{}")
    want = []
    for name, data in files.items():
        for number, line in enumerate(plain(data), 1):
            line, error = line.strip(), None
            try:
                found = json.loads(line)
                if not isinstance(found, dict):
                    error = "Invalid JSON"
            except (json.JSONDecodeError, RecursionError):
                error = "Invalid JSON" if line else "Empty line"
            want.append((name, number, line, error, None if error else list(found)))
    got = [(r.file.rsplit("/", 1)[-1], r.line, r.value, r.error, r["keys"]) for r in J.json_lines(spark, str(tmp_path), range_bytes).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    last = {(r.value, r["last"]) for r in J.json_lines(spark, str(tmp_path), range_bytes).collect() if r["last"]}
    assert last == {('{"a": 1, "a": 2}', '{"a": 2}')}


def test_values_as_python_takes_them(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1, "b": 2, "a": 3}\n\t\n{"a": NaN}\n{"a": Infinity}\n' + " \n" + '{"a": 1.5}\r{"a": 2}')
    good, bad = I.tolerant_jsonl(spark, str(path), "a double, b int")
    found = {r.line: (r.a, r.b, r["keys"]) for r in good.collect()}
    assert found.pop(3)[0] != found.get(3) and found == {1: (3.0, 2, ["a", "b"]), 4: (math.inf, None, ["a"]), 6: (1.5, None, ["a"]), 7: (2.0, None, ["a"])}
    assert {(r.line, r.error) for r in bad.collect()} == {(2, "Empty line"), (5, "Empty line")}
    assert I.strict_jsonl(spark, str(path), "a double").count() == 5
    path.write_bytes(b'{"a": 1}\n \n{"a": "\xff"}\n')
    with pytest.raises(Exception, match="line 3"):
        I.strict_jsonl(spark, str(path), "a string").collect()
    with pytest.raises(Exception, match="gone"):
        J.json_lines(spark, str(tmp_path / "gone")).collect()


def test_batches_are_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(100).select("id", F.lit("é").alias("s"), F.lit(None).cast("int").alias("none")).repartition(4)
    ids = lambda: sorted(json.loads(r.value)["id"] for r in J.json_lines(spark, path).collect())
    assert J.append_jsonl(rows.where("id < 60"), path, "b1") and ids() == list(range(60))
    # a task fails after others have written
    broken = rows.where("id >= 60").select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        J.append_jsonl(broken, path, "b2")
    assert ids() == list(range(60)) and J.batches_of(path) == {"b1": 60}
    # a run is killed after its tasks have written and before the manifest is there
    (tmp_path / "out" / "part-b2-killed-x.jsonl").write_text('{"id": 77}\n')
    assert ids() == list(range(60))
    assert J.append_jsonl(rows.where("id >= 60"), path, "b2") and ids() == list(range(100))
    assert not (tmp_path / "out" / "part-b2-killed-x.jsonl").exists()
    # repeated batches change nothing, neither asked for again nor written at the same time
    assert not J.append_jsonl(rows, path, "b1") and not J.append_jsonl(rows, path, "b2")
    lines = rows.select(F.to_json(F.struct("id")).alias("value"))
    lines.write.format(J.source(spark)).option("path", path).option("batch", "b1").mode("append").save()
    assert ids() == list(range(100)) and J.batches_of(path) == {"b1": 60, "b2": 40}
    assert {"id": 0, "s": "é", "none": None} in [json.loads(r.value) for r in J.json_lines(spark, path).collect()]
    assert J.append_jsonl(rows.limit(0), path, "b3") and J.batches_of(path)["b3"] == 0 and len(ids()) == 100
    with pytest.raises(Exception, match="named"):
        J.append_jsonl(rows, path, "a/b")
