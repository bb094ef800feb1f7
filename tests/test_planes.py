"""Planes, padding and row filters against loops over single places."""

import random

import numpy as np
import pytest

from framewise.operators import planes
from tests.test_rasters import by_id, frame


def test_chroma_between_its_samples():
    """Left, middle and right sites; weights add up to one and edges repeat."""
    for small, factor, site in ((4, 2, 0.5), (4, 2, 1.0), (3, 4, 2.0), (5, 2, 1.5), (1, 2, 1.0), (4, 1, 0.5)):
        w = planes.between(small, factor, site)
        assert w.shape == (small * factor, small) and np.allclose(w.sum(1), 1)
        values = [7.0 * i * i for i in range(small)]
        for i in range(small * factor):
            at = (i + 0.5 - site) / factor
            low = int(np.floor(at))
            a, b = (values[min(max(k, 0), small - 1)] for k in (low, low + 1))
            assert np.isclose((w @ values)[i], a + (b - a) * (at - low))


@pytest.mark.parametrize("matrix", ["709", "601", "2020"])
@pytest.mark.parametrize("full", [True, False])
def test_colours_survive_their_planes(spark, matrix, full):
    """To planes of sixteen bits and back, within two codes; grey has no colour difference."""
    lot = random.Random(1)
    rows = [[[lot.random() for _ in range(12)] for _ in range(3)] for _ in range(3)] + [[[0.25] * 12] * 3, [[0.0] * 12] * 3, [[1.5] * 12, [1.0] * 12, [1.0] * 12]]
    df = frame(spark, rows, "r array<double>, g array<double>, b array<double>")
    kept = planes.stored(df, ("r", "g", "b"), ("y", "u", "v"), 16, full, matrix)
    out = by_id(planes.colours(kept, ("y", "u", "v"), "rgb", (4, 3), depth=16, full=full, matrix=matrix), "rgb", "u", "v")
    for i, row in enumerate(rows):
        want = np.rint(np.clip(np.array(row).T.reshape(-1), 0, 1) * 65535)
        assert np.abs(np.array(out[i][0]) - want).max() <= 2
    assert {*out[3][1], *out[3][2]} == {32768} and out[4][0] == [0] * 36 and out[5][0] == [65535] * 36
    with pytest.raises(ValueError, match="whole samples"):
        planes.colours(df, ("r", "g", "b"), "x", (5, 4), (2, 2))


def test_small_chroma_planes(spark):
    """A flat colour is flat whatever the factors; a step of colour lies where its site says."""
    for depth, full in ((8, False), (10, True)):
        black, span, grey, _ = planes.spans(depth, full)
        df = frame(spark, [[[black + span / 2] * 16, [grey] * 4, [grey] * 4], [None, [grey] * 4, [grey] * 4]], "y array<double>, u array<double>, v array<double>")
        out = by_id(planes.colours(df, ("y", "u", "v"), "rgb", (4, 4), (2, 2), depth, full), "rgb")
        assert {*out[0][0]} <= {32767, 32768} and out[1] == (None,)
    df = frame(spark, [[[126.0] * 8, [128.0] * 2, [128.0, 240.0]]], "y array<double>, u array<double>, v array<double>")
    red = np.array(by_id(planes.colours(df, ("y", "u", "v"), "rgb", (4, 2), (2, 2), site=(0.5, 1.0)), "rgb")[0][0]).reshape(2, 4, 3)[:, :, 0]
    assert (red[0] == red[1]).all() and red[0][0] < red[0][1] < red[0][2] == red[0][3]


def test_padding(spark):
    for size in ((10, 20), (32, 17), (9, 24)):
        lot = random.Random(size[0])
        v = [lot.random() for _ in range(size[0] * size[1])]
        down, right = planes.reflected(size[1]), planes.reflected(size[0]) if size[0] % 16 else 0
        assert 8 <= down < 24 and (size[1] + down) % 16 == 0
        if right >= size[0] or down >= size[1]:
            with pytest.raises(ValueError, match="to mirror"):
                planes.padded(frame(spark, [[v]]), "v", "p", size)
            continue
        wide = size[0] + right + (16 if right else 0)
        got = np.array(by_id(planes.padded(frame(spark, [[v]]), "v", "p", size), "p")[0][0]).reshape(-1, wide)
        assert got.shape[0] == size[1] + down + 16
        for y in range(got.shape[0]):
            for x in range(wide):
                inside = y < size[1] + down and x < size[0] + right
                j, i = (2 * (n - 1) - k if k >= n else k for k, n in ((y, size[1]), (x, size[0])))
                assert got[y, x] == (v[j * size[0] + i] if inside else 0)


def test_lengths_in_fours(spark):
    df = frame(spark, [[[*range(n)]] for n in range(11)] + [[None]])
    out = by_id(df.select("id", planes.in_fours("v").alias("w")), "w")
    for n in range(1, 11):
        assert out[n][0][:n] == [*range(n)] and len(out[n][0]) % 4 == 1 and len(out[n][0]) - n < 4 and {*out[n][0][n:]} <= {n - 1}
    assert out[0] == ([],) and out[11] == (None,)


@pytest.mark.parametrize("step", [1, 3])
def test_filtered_rows_come_back(spark, step):
    lot = random.Random(step)
    rows = [[[lot.randrange(256) for _ in range(6 * 5 * step)]], [[i * 3 % 256 for i in range(6 * 5 * step)]], [[200] * (6 * 5 * step)], [[i // (6 * step) * 40 for i in range(6 * 5 * step)]]]
    df = planes.filtered_rows(frame(spark, rows), "v", "f", (6, 5), step)
    out = by_id(planes.unfiltered_rows(df, "f", "back", (6, 5), step), "v", "back", "f", "f_kind", "f_sums")
    kinds = set()
    for v, back, f, kind, sums in (out[i] for i in range(4)):
        assert [int(x) for x in v] == back
        kinds |= {*kind}
        for y in range(5):
            row = f[y * 6 * step : (y + 1) * 6 * step]
            assert sum(min(x, 256 - x) for x in row) == sums[y * 5 + kind[y]] == min(sums[y * 5 : y * 5 + 5])
    assert len(kinds) >= 3
