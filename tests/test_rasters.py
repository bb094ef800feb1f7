"""Pictures and vectors in numpy batches against loops over single places."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators import pictures, rasters
from framewise.sources.shared import Store


def frame(spark, rows, kind="v array<double>"):
    return spark.createDataFrame([(i, *[None if x is None else [float(y) for y in x] for x in row]) for i, row in enumerate(rows)], f"id long, {kind}").repartition(2)


def by_id(df, *names):
    return {r.id: tuple(r[n] for n in names) for r in df.collect()}


def test_shrinking(spark):
    """Flat pictures stay flat, the centre of mass stays, channels do not mix, and weights are those of the kernel."""
    for size, to in ((48, 13), (27, 27), (5, 9), (8, 1), (1, 4)):
        w = rasters.resampling(size, to)
        assert w.shape == (to, size) and np.allclose(w.sum(1), 1)
        for o in range(to):
            ratio, centre = size / to, (o + 0.5) * size / to
            wide = max(ratio, 1)
            at = range(max(int(centre - 2 * wide + 0.5), 0), min(int(centre + 2 * wide + 0.5), size))
            raw = {i: float(rasters.cubic(np.array((i - centre + 0.5) / wide))) for i in at}
            assert np.allclose(w[o], [raw.get(i, 0) / sum(raw.values()) for i in range(size)])
    lot = random.Random(1)
    rows = [[0.5] * 72, [lot.random() for _ in range(72)], [2.0] * 36 + [-1.0] * 36]
    out = by_id(rasters.shrunk(frame(spark, [[r] for r in rows] + [[None]]), "v", "small", (6, 4), (3, 2), 3), "small")
    assert out[0][0] == [128] * 18 and out[3][0] is None
    x, y = rasters.resampling(6, 3), rasters.resampling(4, 2)
    for k in (1, 2):
        v = np.array(rows[k]).reshape(4, 6, 3)
        want = [min(max(round(255 * sum(y[b, j] * x[a, i] * v[j, i, c] for j in range(4) for i in range(6))), 0), 255) for b in range(2) for a in range(3) for c in range(3)]
        assert out[k][0] == want
    with pytest.raises(Exception, match="no numbers"):
        rasters.shrunk(frame(spark, [[[math.inf] * 4]]), "v", "small", (2, 2), (1, 1)).collect()


def test_arrays_of_unlike_length_are_refused(spark):
    with pytest.raises(Exception, match="arrays of"):
        rasters.rotated(frame(spark, [[[1, 2]], [[1, 2, 3, 4]]]).coalesce(1), "v", "r").collect()
    assert by_id(rasters.rotated(frame(spark, [[[1, 2]], [None]]), "v", "r"), "r")[1] == (None,)
    assert rasters.rotated(frame(spark, []), "v", "r").collect() == []


def test_detail_on_another_low_band(spark):
    lot = random.Random(2)
    a, b = ([[lot.random() for _ in range(30)] for _ in range(4)] for _ in range(2))
    out = by_id(rasters.transferred(frame(spark, [*zip(a, b, strict=True)], "a array<double>, b array<double>"), "a", "b", "m", (6, 5), 2), "m")

    def low(v, gap):
        get = lambda m, y, x: m[min(max(y, 0), 4)][min(max(x, 0), 5)]
        m = [v[i * 6 : i * 6 + 6] for i in range(5)]
        m = [[(get(m, y, x - gap) + 2 * m[y][x] + get(m, y, x + gap)) / 4 for x in range(6)] for y in range(5)]
        return [(get(m, y - gap, x) + 2 * m[y][x] + get(m, y + gap, x)) / 4 for y in range(5) for x in range(6)]

    for i in range(4):
        want = np.array(a[i]) - low(low(a[i], 1), 2) + low(low(b[i], 1), 2)
        assert np.allclose(out[i][0], want)
    same = by_id(rasters.transferred(frame(spark, [(x, x) for x in a], "a array<double>, b array<double>"), "a", "b", "m", (6, 5), 3), "m")
    assert all(np.allclose(same[i][0], a[i]) for i in range(4))


def test_quality_of_single_places(spark):
    lot = random.Random(3)
    a, b = ([lot.random() * 255 for _ in range(144)] for _ in range(2))
    ssim, lap, dev = by_id(rasters.quality(frame(spark, [(a, b)], "a array<double>, b array<double>"), "a", "b", (12, 12), pictures.gaussian(11, 1.5)), "ssim", "laplacian", "deviation")[0]
    turn = lambda p: 22 - abs(p) if abs(p) > 11 else abs(p)
    g = pictures.gaussian(11, 1.5)
    near = lambda v, y, x, w: sum(w[j] * w[i] * v[turn(y + j - len(w) // 2) * 12 + turn(x + i - len(w) // 2)] for j in range(len(w)) for i in range(len(w)))
    each, laps, devs = [], [], []
    for y in range(12):
        for x in range(12):
            ma, mb = near(a, y, x, g), near(b, y, x, g)
            va, vb, c = (near([p * q for p, q in zip(*pair, strict=True)], y, x, g) - m for pair, m in (((a, a), ma * ma), ((b, b), mb * mb), ((a, b), ma * mb)))
            each.append((2 * ma * mb + 6.5025) * (2 * c + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)))
            at = lambda j, i: a[turn(j) * 12 + turn(i)]
            laps.append(at(y, x - 1) + at(y, x + 1) + at(y - 1, x) + at(y + 1, x) - 4 * at(y, x))
            box = (1 / 9,) * 9
            devs.append(math.sqrt(max(near([p * p for p in a], y, x, box) - near(a, y, x, box) ** 2, 0)))
    assert np.allclose([ssim, lap, dev], [np.mean(each), np.var(laps), np.mean(devs)])


@pytest.mark.parametrize("bits", [1, 3, 4, 5, 6, 8])
def test_packed_codes_come_back(spark, bits):
    lot = random.Random(bits)
    rows = [[[lot.gauss(0, 3) for _ in range(40)]], [[7.0] * 40], [[0.0] * 20 + [1.0] * 20], [None]]
    packed = rasters.packed(frame(spark, rows), "v", "p", bits, 10)
    out = by_id(rasters.unpacked(packed, "p", "x", bits, 10), "v", "p", "p_scale", "x", "x_codes")
    assert out[3] == (None,) * 5
    for i in range(3):
        v, raw, scale, x, codes = out[i]
        assert len(raw) == -(-40 * bits // 8) and all(0 <= c < 1 << bits for c in codes)
        whole = int.from_bytes(raw, "little")
        assert codes == [whole >> k * bits & (1 << bits) - 1 for k in range(40)]
        assert all(abs(a - b) <= s / 2 + 1e-9 for a, b, s in zip(v, x, np.repeat(scale, 10), strict=True))
    with pytest.raises(Exception, match="bytes, where"):
        rasters.unpacked(packed.withColumn("p", F.expr("substring(p, 2)")), "p", "x", bits, 10).collect()


def test_whole_number_products(spark):
    """Blocks smaller than rows, columns and depth; repeated rows of one key are an error of the caller's."""
    rng = np.random.default_rng(4)
    a, b = rng.integers(-127, 128, (37, 50)), rng.integers(-127, 128, (11, 50))
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "r long, codes array<int>")
    right = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(b)], "c long, codes array<int>")
    for block, depth in ((1024, 256), (5, 7)):
        out = rasters.product(left, right, "r", "c", "codes", block, depth).collect()
        assert len(out) == 37 * 11 and all(x.value == (a @ b.T)[x.r, x.c - 100] for x in out)
    assert rasters.product(left.limit(0), right, "r", "c", "codes").collect() == []


def test_windows_apart_as_one_by_one(spark):
    """Ties, flat maps and slopes; the choice equals the one that takes the best left again and again."""
    lot = random.Random(8)
    maps = [[lot.randrange(6) for _ in range(10 * 8)], [1] * 80, [*range(80)], [-i for i in range(80)]]
    df = frame(spark, [[m] for m in maps])
    scores = rasters.window_scores(df, "id", "v", (10, 8), (3, 2), 1)
    found = {}
    for r in rasters.apart(scores, "id", (3, 2), Store(spark, "apart")).collect():
        found.setdefault(r.id, set()).add((r.x, r.y))
    for i, m in enumerate(maps):
        every = {(x, y): sum(m[(y + k) * 10 + x + j] for k in range(2) for j in range(3)) / 6 for x in range(8) for y in range(7)}
        got = {(r.x, r.y): r.score for r in scores.where(F.col("id") == i).collect()}
        assert got.keys() == every.keys() and all(abs(got[k] - v) < 1e-9 for k, v in every.items())
        taken = []
        for x, y in sorted(got, key=lambda k: (-got[k], k[1], k[0])):
            if all(abs(x - a) >= 3 or abs(y - b) >= 2 for a, b in taken):
                taken.append((x, y))
        assert found[i] == {*taken}
    assert rasters.apart(scores.limit(0), "id", (3, 2), Store(spark, "apart")).collect() == []
