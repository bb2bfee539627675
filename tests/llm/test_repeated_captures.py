"""Captures of one page that run over several index shards."""

from pactlake.llm import warc


def test_repeated_rows_across_shards_are_all_read_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    monkeypatch.setattr(warc, "SHARD_LINES", 3)
    rows = [(1, "http://a.b/x", f"page {k}") for k in range(40)] + [(None, None, f"none {k}") for k in range(40)] + [(k, f"http://c.d/{k}", "q") for k in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder, shards = warc.archive(pages)
    assert len(shards) > 10
    got = warc.read_back(pages, shards, folder).collect()
    assert len(got) == len(rows) and sum(r["page_id"] == 1 for r in got) == 40 + 1
    assert len(warc.lookup(shards, folder, "http://a.b/x", 1)) == 40
