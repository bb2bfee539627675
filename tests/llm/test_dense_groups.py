"""Groups of thousands of different vectors that all link, against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from pactlake.llm import embeddings


@pytest.mark.parametrize("cell", [8192, 1000])
def test_all_links_of_a_dense_group_are_counted(spark, monkeypatch, cell):
    monkeypatch.setattr(embeddings, "CELL", cell)
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(64)
    x = (centre + 0.2 * rng.standard_normal((3000, 64))).astype("f4")
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    units = embeddings._unit_rows(x.astype(float))
    want = (units @ units.T >= embeddings.THRESHOLD).sum(axis=1) - 1
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert [got[k]["n_links"] for k in range(3000)] == want.tolist() and want.mean() > 2000
    assert all(r["component_id"] == 0 for r in got.values())


@pytest.mark.parametrize("n", [4096, 16_384, 65_536])
def test_recall_in_one_dense_label(spark, n):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal(64) + 0.2 * rng.standard_normal((n, 64))).astype("f4")
    units = embeddings._unit_rows(x.astype(float))
    want = sum(int((units[k : k + 1024] @ units.T >= embeddings.THRESHOLD).sum()) for k in range(0, n, 1024)) - n
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 64).cast(pa.list_(pa.float32())), "label": np.ones(n, "i4")})
    got = embeddings.near_duplicates(spark.createDataFrame(table)).selectExpr("sum(n_links)", "max(component_id)").first()
    assert 0.999 * want <= got[0] <= want and got[1] == 0


def test_recall_in_a_large_label_of_many_groups(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((1500, 32))
    x = (centres[rng.integers(0, 1500, 20_000)] + 0.25 * rng.standard_normal((20_000, 32))).astype("f4")
    units = embeddings._unit_rows(x.astype(float))
    want = np.concatenate([(units[k : k + 1000] @ units.T >= embeddings.THRESHOLD).sum(axis=1) - 1 for k in range(0, 20_000, 1000)])
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 32).cast(pa.list_(pa.float32())), "label": np.ones(len(x), "i4")})
    got = embeddings.near_duplicates(spark.createDataFrame(table)).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() > 50_000
