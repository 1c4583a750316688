"""Single rules that have queries, in the cases that these do not have."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tessera.operators import datasets as D
from tessera.sources import readers as I


def test_metric_lines_of_all_events(spark, tmp_path, monkeypatch):
    from tessera.plans import queries

    rows = [(i, kind, i / 8) for i, kind in enumerate(["click", "view", "view", "click", "buy", "buy", None])]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    read, lines = queries.metric_lines, []
    monkeypatch.setattr(queries, "metric_lines", lambda x: lines.extend(r.value for r in x.collect()) or read(x))
    got = sorted(tuple(r) for r in queries.metric_log_extract(spark, str(tmp_path)).collect())
    assert got == [(0, 0, 0.0, "yes"), (3, 3, 0.375, "yes")]
    assert len(lines) == 7 and {("METRICS " in x, "total_ms=" in x) for x in lines} == {(True, True), (False, True), (True, False)}


def test_periods_without_times(spark):
    rows = spark.createDataFrame([(d, p) for d in ("2026-05-04", "2026-5-4", "no date", None) for p in (None, "", "spring", "May", "Q3", "June 2026", "Q2 2026", "may 2025")], "d string, p string")
    got = {(r.d, r.p): r.x for r in rows.select("d", "p", D.period_coherent(F.col("d"), F.col("p")).alias("x")).collect()}
    for (d, p), x in got.items():
        assert x == (d in ("no date", None) or p not in ("Q3", "June 2026", "may 2025")), (d, p)


def test_events_in_order(spark):
    rows = [(3, None), (1, None), (2, "2026-01-02"), (5, "2026-01-01"), (4, "2026-01-02")]
    got = D.events_in_order(spark.createDataFrame(rows, "id int, day string"), "day", ["id"], "place").collect()
    assert {r.id: r.place for r in got} == {5: 1, 2: 2, 4: 3, 1: 4, 3: 5}


def test_calendars_begin_now(spark):
    now = int(datetime.now(timezone.utc).timestamp() * 1000)
    rows = spark.createDataFrame([(1, "c", "past", now - 10_000_000, 0, False), (2, "c", "soon", now + 10_000_000, 0, False), (3, "c", "far", now + 91 * 86_400_000, 0, False)], "id int, calendarName string, title string, startMillis long, endMillis long, allDay boolean")
    assert [r.id for r in I.calendar_range(rows).collect()] == [2]
