"""Registered queries without SQL over whole tables: small fixtures with results worked out by hand."""

from quarry.operators import themes as K
from quarry.plans import pages


def test_sweep_tries_the_whole_band(spark, tmp_path, monkeypatch):
    rows = [(16 * j + c, [10.0 * (c == d) + 0.01 * ((7 * j + 3 * d) % 5) for d in range(16)]) for c in range(16) for j in range(10)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    bands, band = [], K.thread_band
    monkeypatch.setattr(K, "thread_band", lambda *a: bands.append(band(*a)) or bands[-1])
    got = pages.kmeans_sweep(spark, str(tmp_path)).first()
    assert bands == [[6, 8, 10, 12, 14, 16, 18, 20]]
    assert 12 < got.k <= 20 and got.silhouette > 0.9
    assert band(500) == list(range(12, 41, 2))


def test_connected_works_takes_all_rows(spark, tmp_path):
    # orders 1 and 2 share part 5, 2 and 3 part 6; 7 and 8 share part 9; 14 stands with its own part
    rows = [(1, 5), (2, 5), (2, 6), (3, 6), (7, 9), (8, 9), (14, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.component: r.n for r in pages.connected_works(spark, str(tmp_path)).collect()} == {1: 5, 7: 3, 14: 2}
