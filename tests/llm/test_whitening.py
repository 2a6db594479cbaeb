"""Whitening against a plain eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import spectral_whitening
from tidemark.llm.queries import op12_spectral_whitening

ROWS = "vec_id long, embedding array<float>"


def reference(rows, components=4, scale=256):
    """vec_id, component -> n, deviation, whitened without its sign, explained."""
    kept = [(i, tuple(int(np.floor(scale * float(np.float32(c)))) for c in v)) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.asarray(sorted({v for _, v in kept}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = ((n * fit - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = []
    for i, v in kept:
        apart = n * np.asarray(v, dtype=object) - sums
        for k in range(min(components, fit.shape[1])):
            e, u = values[-1 - k], vectors[:, -1 - k]
            white = abs(float((apart / n).astype(float) @ u)) / np.sqrt(e) if e > 1e-9 * values[-1] else None
            out.append((i, k + 1, n, int((apart**2).sum()), white, e / values.sum() if values[-1] > 0 else None))
    return out


def whitened(frame, **more):
    return spectral_whitening.whiten(frame.select("*", spectral_whitening.quantized("embedding").alias("vector")), **more)


def compare(got, want):
    got = sorted(got, key=lambda r: (r["vec_id"] is None, r["vec_id"], r["component"], r["deviation"]))
    want = sorted(want, key=lambda r: (r[0] is None, r[0], r[1], r[3]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g["vec_id"], g["component"], g["n"], g["deviation"]) == w[:4]
        if w[4] is None:
            assert g["whitened"] is None
        else:
            assert abs(g["whitened"]) == pytest.approx(w[4], abs=1e-9)
            assert g["identity_error"] < 1e-9
        assert g["explained"] == (None if w[5] is None else pytest.approx(w[5], rel=1e-9, abs=1e-12))


def stretched(rng, n, dim):
    return (rng.normal(size=(n, dim)) * np.linspace(1.5, 0.2, dim)) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0]


@pytest.mark.parametrize("block,parts", [(1, 3), (512, 3), (7, 40)])
def test_whitening_matches_an_eigendecomposition(spark, monkeypatch, block, parts):
    monkeypatch.setattr(spectral_whitening, "FAN", 3)
    rng = np.random.default_rng(block)
    vectors = stretched(rng, 300, 12).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[5]) for i in range(200)]
    rows += [(0, vectors[0]), (None, vectors[1]), (-1, None), (-2, [None] + vectors[0][1:]), (-3, [float("nan")] + vectors[0][1:]), (-4, [float("-inf")] + vectors[0][1:])]
    frame = spark.createDataFrame(rows, ROWS).withColumn("component", F.lit("clash")).withColumn("n", F.lit(0)).repartition(parts)
    compare(whitened(frame, block=block).collect(), reference(rows))


@pytest.mark.parametrize("rank", [1, 2])
def test_fewer_independent_vectors_than_components(spark, rank):
    rng = np.random.default_rng(rank)
    vectors = (rng.integers(-8, 8, (50, rank)) @ rng.integers(-4, 5, (rank, 6))).astype(float).tolist()
    rows = list(enumerate(vectors))
    compare(whitened(spark.createDataFrame(rows, ROWS)).collect(), reference(rows))


def test_one_distinct_vector_has_no_whitened_values(spark):
    got = whitened(spark.createDataFrame([(1, [0.5, -0.0]), (2, [0.5, 0.0])], ROWS)).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(got)] == [
        (i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)]


def test_tables_without_vectors(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitened(spark.createDataFrame(rows, ROWS)).collect() == []


def test_lengths_are_fitted_apart(spark):
    rng = np.random.default_rng(3)
    short, long = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 3)))], [(100 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 5)))]
    compare(whitened(spark.createDataFrame(short + long, ROWS)).collect(), reference(short) + reference(long))


def test_entries_beyond_a_long(spark):
    rows = [(i, [float(i), 3e38 if i == 7 else 1.0]) for i in range(30)]
    got = whitened(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == 60 and {r["n"] for r in got} == {30}
    assert all(r["deviation"] is None for r in got)  # the squares don't fit


def test_rank_one_updates_keep_the_spectrum():
    rng = np.random.default_rng(0)
    for dim in (1, 2, 5, 33):
        values, basis, total = np.zeros(dim), np.eye(dim), np.zeros((dim, dim))
        for step in range(120):
            v = rng.normal(size=dim) * 10.0 ** rng.integers(-3, 4)
            if step % 5 == 0:
                v = np.eye(dim)[step % dim]
            if step % 7 == 0:
                v = np.zeros(dim)
            values, basis = spectral_whitening.rank_one(values, basis, v)
            total += np.outer(v, v)
        size = np.abs(total).max()
        assert np.allclose(basis.T @ basis, np.eye(dim), atol=1e-12)
        assert np.allclose((basis * values) @ basis.T, total, atol=1e-12 * size)
        assert (np.diff(values) >= 0).all()


def test_the_registered_query(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(stretched(rng, 64, 8).astype(np.float32))]
    spark.createDataFrame(rows, ROWS).withColumn("label", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_spectral_whitening(spark, str(tmp_path))
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got.collect(), reference(rows))
