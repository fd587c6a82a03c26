"""Percentiles of hot groups without a task that holds them, sketches, rolling frames."""

import numpy as np
import pytest

from tidewell.operators import quantiles as Q

PS = [0.0, 0.25, 0.5, 0.95, 1.0]


def shapes():
    rng = np.random.default_rng(4)
    return {
        "even": rng.random(3000), "one": np.full(2500, 7.5), "hot": np.concatenate([np.full(2000, 3.0), rng.random(700) * 6]), "steep": 10 ** rng.uniform(-200, 200, 2600), "two": np.repeat([1.0, 2.0], 1500),
        "few": np.array([5.0, 1.0, 3.0]), "signs": rng.normal(size=2800),
    }


def test_percentiles_of_large_groups_are_exact(spark):
    groups = shapes()
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None), ("none", None), (None, 2.0)] + [(None, float(v)) for v in range(900)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in Q.exact_percentiles(df, ["g"], "v", PS, most=100).collect()}
    groups[None] = np.array([2.0, *range(900)])
    assert set(got) == {*groups, "none"} and got["none"].n == 0 and got["none"].p0 is None
    for g, vs in groups.items():
        assert got[g].n == len(vs)
        assert np.allclose([got[g][f"p{j}"] for j in range(len(PS))], np.quantile(vs, PS), rtol=1e-12, atol=0), g


def test_percentiles_without_groups_and_without_rows(spark):
    df = spark.createDataFrame([(float(v % 37),) for v in range(1200)], "v double")
    assert [r[1:] for r in Q.exact_percentiles(df, [], "v", [0.5], most=50).collect()] == [(float(np.median([v % 37 for v in range(1200)])),)]
    assert Q.exact_percentiles(df.limit(0), [], "v", [0.5]).count() == 0


def test_merged_sketches_keep_their_error(spark):
    v = np.random.default_rng(1).normal(size=20000)
    df = spark.createDataFrame([(i % 7, float(x)) for i, x in enumerate(v)], "day int, v double")
    merged = Q.merged_sketches(Q.sketches(df, ["day"], "v"), [])
    got = Q.sketch_percentiles(merged, [0.5, 0.95]).first()
    for p, x in zip((0.5, 0.95), got, strict=True):
        assert abs((v < x).mean() - p) < 0.01


@pytest.mark.parametrize("frame", [1, 5, 60])
def test_rolling_percentile_over_segments_and_blocks(spark, monkeypatch, frame):
    monkeypatch.setattr(Q, "SEGMENT_ROWS", 16)
    monkeypatch.setattr(Q, "BLOCK_BITS", 3)
    rng = np.random.default_rng(frame)
    rows = [(g, int(i) * 3 - 50, None if rng.random() < 0.1 else float(rng.integers(9))) for g in (1, 2) for i in rng.permutation(150)]
    got = {(r.g, r.i): r.p for r in Q.rolling_percentile(spark.createDataFrame(rows, "g int, i long, x double"), ["g"], "i", "x", 0.95, frame).collect()}
    assert len(got) == len(rows)
    for g in (1, 2):
        mine = sorted((i, x) for h, i, x in rows if h == g)
        for at, (i, _) in enumerate(mine):
            vs = [x for _, x in mine[max(0, at - frame + 1) : at + 1] if x is not None]
            want = np.quantile(vs, 0.95) if vs else None
            assert (got[g, i] is None or np.isnan(got[g, i])) if want is None else abs(got[g, i] - want) < 1e-9
