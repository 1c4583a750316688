"""Lines of JSON get their numbers without a shuffle of the lines."""

from tessera.sources.jsonl import json_lines


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"n":{k}}}\n' for k in range(1, 51)))
    read = json_lines(spark, str(tmp_path), range_bytes=64)
    assert "SortMergeJoin" not in read._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["line"], r["value"]) for r in read.collect()) == [(k, f'{{"n":{k}}}') for k in range(1, 51)]
