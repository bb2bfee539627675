"""Embeddings against brute force, archives as a round trip, and the pipeline against plain rules."""

import base64
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pactlake.llm import embeddings, quality, queries, warc

SF = "/root/testdata/sf0.001"


# --- embeddings ------------------------------------------------------------


def brute_links(rows, threshold=0.93):
    ids = [i for i, _, _ in rows]
    units = embeddings._unit_rows(np.array([v for _, v, _ in rows], float))
    labels = np.array([l for _, _, l in rows])
    g = (units @ units.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(g, False)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(np.triu(g)), strict=True):
        x, y = root(ids[a]), root(ids[b])
        parent[max(x, y)] = min(x, y)
    return {i: int(n) for i, n in zip(ids, g.sum(axis=1), strict=True)}, {i: root(i) for i in ids}


def clustered(n=700, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres, rows = rng.standard_normal((40, dim)), []
    for k in range(n):
        c = centres[0] if k % 3 == 0 else centres[rng.integers(40)]
        rows.append((k, (c + 0.12 * np.linalg.norm(c) / dim**0.5 * rng.standard_normal(dim) * rng.choice([0.5, 3])).astype("f4").tolist(), int(k % 5 > 1)))
    return rows + [(n + k, rows[0][1], rows[0][2]) for k in range(30)]


@pytest.mark.parametrize("caps", [(8192, 64, 4096), (150, 40, 16)])
def test_links_reach_the_recall_of_brute_force(spark, monkeypatch, caps):
    for name, value in zip(("CELL", "LEAF", "TILE"), caps, strict=True):
        monkeypatch.setattr(embeddings, name, value)
    rows = clustered()
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    n, component = brute_links(rows)
    assert all(got[i]["n_links"] <= n[i] for i in n)
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * sum(n.values())
    assert np.mean([got[i]["component_id"] == component[i] for i in n]) > 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_odd_vectors(spark):
    v = [0.3, -1.0, 0.2, 0.9]
    rows = [
        (1, v, 1), (2, v, 1), (3, [2 * x for x in v], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0] * 4, 1), (8, [float("nan"), *v[1:]], 1), (9, [None, *v[1:]], 1),
        (10, [], 1), (11, [*v, 1.0], 1), (None, v, 1), (12, [-x for x in v], 1), (2, v, 1), (13, [float("inf"), *v[1:]], 1), (14, [1e-30 * x for x in v], 1),
    ]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, label int, n_links string, component int")
    got = {}
    for r in embeddings.near_duplicates(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert got[1] == [(4, 1, True)] and got[2] == [(4, 1, False)] * 2 and got[3] == [(4, 1, False)] and got[14] == [(4, 1, False)]
    assert all(got[k] == [(0, k, True)] for k in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13)) and got[None] == [(0, None, None)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    text = {r["vec_id"]: r["component_id"] for r in embeddings.near_duplicates(df.withColumn("vec_id", F.concat(F.lit("v"), "vec_id"))).collect()}
    assert text["v14"] == "v1" and text["v4"] == "v4"
    reused = spark.createDataFrame([(1, v, 1), (1, [-x for x in v], 2), (2, v, 1), (3, [-x for x in v], 2)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in embeddings.near_duplicates(reused).collect()) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


# --- archives --------------------------------------------------------------

PAGES = [(1, "http://a.b/x", "<p>"), (1, "http://a.b/x", "<p>"), (2, None, None), (3, "http://[bad", ""), (4, "http://é.com/a b\n", "<p>"), (None, None, "zz"), (7, "http://a.b:99999/", "q"), (8, "http://a.b/x", "é\r\n\r\n" * 3000)]


def facts(rows):
    best = {}
    for p, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
    out = []
    for p, _, h in rows:
        raw, top = (h or "").encode(), best[h or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((p, len(raw), digest, "response" if top in (-1, p) else "revisit", None if top in (-1, p) else top))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [(500, 4000), (2, 3)])
def test_archives_are_read_back_as_written(spark, monkeypatch, limits):
    monkeypatch.setattr(warc, "BLOCK_LINES", limits[0])
    monkeypatch.setattr(warc, "SHARD_LINES", limits[1])
    rows = PAGES + [(100 + k, f"https://www.s{k % 3}.org/p?q={k % 11}", f"page {k % 9}") for k in range(60)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload_bytes string").repartition(3)
    folder, shards = warc.archive(pages)
    assert sorted((tuple(r) for r in warc.read_back(pages, shards, folder).collect()), key=str) == facts(rows)
    assert [len(r["payload"]) for r in warc.lookup(shards, folder, "http://a.b/x", 8)] == [len("é\r\n\r\n".encode()) * 3000]
    assert len(warc.lookup(shards, folder, "http://a.b/x", 1)) == 2 and not warc.lookup(shards, folder, "http://nowhere", 1)


def test_an_empty_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder, shards = warc.archive(pages)
    assert shards == [] and warc.read_back(pages, shards, folder).count() == 0 and warc.lookup(shards, folder, None, None) == []


def test_url_keys_and_records():
    assert warc.url_key("HTTP://WWW.Example.com:8080/A?b=c#d") == "com,example,www:8080)/A?b=c"
    assert warc.url_key(None) == "-" and "\n" not in warc.url_key("http://a/\n b") and " " not in warc.url_key("x y")
    got = warc.parse_record(warc.page_record(5, "http://a/b c", b"\r\n\r\nbody", 9, False))
    assert got["payload"] == b"\r\n\r\nbody" and got["headers"]["warc-type"] == "response" and got["headers"]["warc-target-uri"] == "http://a/b%20c"


# --- queries and pipeline --------------------------------------------------


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", [n for n in queries.queries() if n.split("_")[0] not in ("op11", "op13")])
def test_queries_return_a_row_for_each_input_row(spark, name):
    df = queries.queries()[name](spark, SF)
    source = {"op2": "embeddings", "op6": "pages"}.get(name.split("_")[0], "documents")
    assert df.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_pipeline_against_plain_rules(spark):
    from tests.llm.test_similar_texts import plain_kept
    from tests.llm.test_text_operators import brute_hits, plain_spans_and_terms
    from tokenizers import Tokenizer

    from pactlake.llm import bpe, pii

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    of = quality.Indicators()
    rows = sorted((r for r in docs.collect() if model.score(of(r["text"].encode())) >= 0.5), key=lambda r: r["doc_id"])
    kept = plain_kept([r["text"] for r in rows])
    rows = [r for k, r in enumerate(rows) if k in kept]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_hits([(r["doc_id"], r["text"]) for r in rows], items)
    rows = [r for r, (_, hit, _) in zip(rows, hits, strict=True) if not hit]
    found = plain_spans_and_terms([r["text"] for r in rows])
    t = Tokenizer.from_file(bpe.default_tokenizer())
    terms = sum(s[0] == "term" for spans in found for s in spans)
    want = {r["doc_id"]: t.encode(pii.redact(r["text"], spans), add_special_tokens=False).ids for r, spans in zip(rows, found, strict=True)}
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < docs.count() and terms > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_terms_are_found_on_the_tables(spark):
    assert queries.queries()["op8_pii_disclosure"](spark, "/root/testdata/sf0.01").where("spans like '%term:%'").count() > 0


def test_stages_on_odd_and_empty_documents(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "quick brown")], "item_id long, text string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    more = ["y", "fp", "hits", "items", "n_words", "spans", "clean", "places", "lang_pred", "h", "good", "__clean", "n_chars", "ids", "n_tokens", "part", "group", "__whole", "__terms", "__h", "__id", "__of", "__again", "__hits", "__text__"]
    for docs in (odd, none):
        for k, c in enumerate(more):
            docs = docs.withColumn(c, F.lit(k).cast("long"))
        own = lambda r: [r[c] for c in ["doc_id", *more, "score", "lang", "source"] if c != "n_chars"]
        start = [own(r) for r in docs.collect()]
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "encoding":
                assert out.schema.names == docs.columns
                assert all(own(r) in start for r in out.collect())  # the user's own columns are as they were
            docs = out
        assert docs.count() <= odd.count()


def test_steps_of_a_stage_go(spark):
    from pactlake.llm import common

    before = set(common._steps)
    with common.own_steps():
        common.materialize(spark.range(3))
        kept = common.materialize(spark.range(4))
    assert set(common._steps) - before == {kept._step} and kept.count() == 4
    common.drop_step(kept)
    assert set(common._steps) == before


def test_a_local_folder_is_refused_on_a_cluster():
    from pactlake.llm import common

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: {"spark.master": "yarn"}.get(name, default))

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


@pytest.mark.parametrize("name", [n for n in queries.queries() if n.split("_")[0] not in ("op2", "op6", "op11", "op13")])
def test_bytes_that_are_not_utf8(spark, tmp_path, name):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(30)], "doc_id long, quality int, toxic int")
    rows = [(k, bytearray(f"some words about thing {k} a@b.co ".encode() + bytes([0xC3, 0x28, 0xFF, k])), "en") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text binary, lang string").selectExpr("doc_id", "cast(text as string) text", "lang", "lang as y", "doc_id as score")
    for n, df in (("labels", labels), ("documents", docs), ("benchmark", spark.createDataFrame([(1, "about thing")], "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{n}.parquet"))
    assert queries.queries()[name](spark, str(tmp_path)).count() == 30
