"""Converting archives: files meet what their revisits refer to as they are; records are not unpacked before they are dealt out."""

from tessera.llm import archives

def test_records_are_unpacked_where_they_are_packed_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", 300)  # some records to an archive
    plans, write = [], archives._write

    def seen(rows, path):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        write(rows, path)

    monkeypatch.setattr(archives, "_write", seen)
    pages = spark.createDataFrame([(i, f"http://x/{i}", "same" if i % 3 == 0 else f"page {i}") for i in range(40)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in archives.pages_through_archives(pages).collect()}
    assert [p.count("MapInArrow") for p in plans] == [1, 1]
    assert len(rows) == 40 and {r["refers_to"] for r in rows.values() if r["record_type"] == "revisit"} == {39}
    assert sorted(k for k, r in rows.items() if r["record_type"] == "revisit") == list(range(0, 39, 3))
    assert all(r["payload_bytes"] == len("same" if k % 3 == 0 else f"page {k}") for k, r in rows.items())
    assert rows[0]["payload_digest"] == rows[39]["payload_digest"] == archives.digest(b"same")
