"""Stored planes to colours and back, padded pictures, and the row filters of still pictures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rasters import computed

#: What red and blue weigh in luma, by matrix.
WEIGHTS = {"709": (0.2126, 0.0722), "601": (0.299, 0.114), "2020": (0.2627, 0.0593)}
#: The names of row filters in the order of their numbers.
FILTERS = ("none", "sub", "up", "average", "paeth")


def spans(depth: int, full: bool) -> tuple[float, float, float, float]:
    """Codes of black, from black to white, of no colour, and from the least to the most colour."""
    if full:
        return 0.0, 2.0**depth - 1, 2.0 ** (depth - 1), 2.0**depth - 1
    unit = 2.0 ** (depth - 8)
    return 16 * unit, 219 * unit, 128 * unit, 224 * unit


def between(small: int, factor: int, site: float) -> np.ndarray:
    """Weights of ``small`` samples for ``small * factor`` places: each place between the two samples around it, the first of
    which lies ``site`` places from the edge; beyond the outermost, that one."""
    place = (np.arange(small * factor) + 0.5 - site) / factor
    left = np.floor(place).astype(int)
    out = np.zeros((small * factor, small))
    rows = np.arange(small * factor)
    np.add.at(out, (rows, np.clip(left, 0, small - 1)), 1 - (place - left))
    np.add.at(out, (rows, np.clip(left + 1, 0, small - 1)), place - left)
    return out


def colours(df: DataFrame, planes: tuple[str, str, str], out: str, size: tuple[int, int], factors: tuple[int, int] = (1, 1), depth: int = 8, full: bool = False, matrix: str = "709", site: tuple[float, float] | None = None) -> DataFrame:
    """Adds ``out``: red, green and blue of each place together, as codes of 16 bits, of the planes of luma and two colour
    differences in ``planes``. The latter have one sample for ``factors`` (across, down) places, sited ``site`` from a
    corner, in the middle by default. Sizes that the factors do not divide are an error."""
    if size[0] % factors[0] or size[1] % factors[1]:
        raise ValueError(f"pictures of {size} have no whole samples for {factors} places")
    small = size[0] // factors[0], size[1] // factors[1]
    site = site or (factors[0] / 2, factors[1] / 2)
    across, down = between(small[0], factors[0], site[0]), between(small[1], factors[1], site[1])
    black, luma_span, grey, colour_span = spans(depth, full)
    red, blue = WEIGHTS[matrix]

    def make(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        wide = lambda c: np.einsum("yj,nji,xi->nyx", down, (c.reshape(-1, small[1], small[0]) - grey) / colour_span, across, optimize=True)
        luma = (y.reshape(-1, size[1], size[0]) - black) / luma_span
        r, b = luma + 2 * (1 - red) * wide(v), luma + 2 * (1 - blue) * wide(u)
        g = (luma - red * r - blue * b) / (1 - red - blue)
        return [np.rint(np.clip(np.stack([r, g, b], 3), 0, 1) * 65535).astype(int).reshape(len(y), -1)]

    return computed(df, list(planes), {out: "array<int>"}, make)


def stored(df: DataFrame, rgb: tuple[str, str, str], out: tuple[str, str, str], depth: int = 16, full: bool = False, matrix: str = "709") -> DataFrame:
    """Adds the planes ``out`` of unit-range samples in the columns ``rgb``, one sample of each a place, clipped first."""
    black, luma_span, grey, colour_span = spans(depth, full)
    red, blue = WEIGHTS[matrix]

    def make(*channels: np.ndarray) -> list[np.ndarray]:
        r, g, b = (np.clip(c, 0, 1) for c in channels)
        y = red * r + (1 - red - blue) * g + blue * b
        made = black + luma_span * y, grey + colour_span * (b - y) / (2 * (1 - blue)), grey + colour_span * (r - y) / (2 * (1 - red))
        return [np.clip(np.rint(p), 0, 2**depth - 1).astype(int) for p in made]

    return computed(df, list(rgb), dict.fromkeys(out, "array<int>"), make)


def reflected(side: int, multiple: int = 16, least: int = 8) -> int:
    """The fewest places, at least ``least``, that bring a side to a multiple."""
    return (-side - least) % multiple + least


def padded(df: DataFrame, name: str, out: str, size: tuple[int, int], multiple: int = 16, least: int = 8, black: int = 16) -> DataFrame:
    """Adds ``out``: pictures with ``reflected`` rows of their own below, mirrored without the edge, then ``black`` rows of
    zeros; columns on the right likewise, but none where the width is a multiple already."""
    down, right = reflected(size[1], multiple, least), reflected(size[0], multiple, least) if size[0] % multiple else 0
    if down >= size[1] or right >= size[0]:
        raise ValueError(f"pictures of {size} have no {down} rows and {right} columns to mirror")

    def make(v: np.ndarray) -> list[np.ndarray]:
        wide = np.pad(v.reshape(-1, size[1], size[0]), [(0, 0), (0, down), (0, right)], mode="reflect")
        return [np.pad(wide, [(0, 0), (0, black), (0, black if right else 0)]).reshape(len(v), -1)]

    return computed(df, [name], {out: "array<double>"}, make)


def in_fours(frames: Column | str) -> Column:
    """A sequence with its last entry repeated until its length is one more than a multiple of four; an empty one stays."""
    frames = F.col(frames) if isinstance(frames, str) else frames
    more = F.pmod(1 - F.size(frames), F.lit(4))
    return F.when(F.size(frames) > 0, F.concat(frames, F.array_repeat(F.element_at(frames, -1), more))).otherwise(frames)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, upper and upper left the one nearest to left + upper - upper left, in this order where two are as near."""
    guess = a + b - c
    near = np.stack([np.abs(guess - x) for x in (a, b, c)])
    return np.choose(near.argmin(0), [a, b, c])


def filtered_rows(df: DataFrame, name: str, out: str, size: tuple[int, int], step: int = 1) -> DataFrame:
    """Adds ``out`` and ``<out>_kind``: each row of byte samples by the filter that leaves the least sum of magnitudes, bytes
    from 128 on counting as what they lack to 256 (ties: the first), and which filter that is; samples ``step`` apart are of
    one channel. ``<out>_sums`` has the sums, row by row, in the order of ``FILTERS``."""

    def make(v: np.ndarray) -> list[np.ndarray]:
        x = v.reshape(-1, size[1], size[0] * step).astype(int)
        left, up = np.zeros_like(x), np.zeros_like(x)
        left[:, :, step:], up[:, 1:] = x[:, :, :-step], x[:, :-1]
        corner = np.zeros_like(x)
        corner[:, 1:, step:] = x[:, :-1, :-step]
        each = np.stack([(x - guess) % 256 for guess in (np.zeros_like(x), left, up, (left + up) // 2, _paeth(left, up, corner))], 2)
        sums = np.minimum(each, 256 - each).sum(3)
        kind = sums.argmin(2)
        rows = np.take_along_axis(each, kind[:, :, None, None], 2)[:, :, 0]
        return [rows.reshape(len(v), -1), kind, sums.reshape(len(v), -1)]

    return computed(df, [name], {out: "array<int>", f"{out}_kind": "array<int>", f"{out}_sums": "array<int>"}, make)


def unfiltered_rows(df: DataFrame, name: str, out: str, size: tuple[int, int], step: int = 1) -> DataFrame:
    """Adds ``out``, the samples of ``filtered_rows`` in ``name``."""

    def make(v: np.ndarray, kinds: np.ndarray) -> list[np.ndarray]:
        n, width = len(v), size[0] * step
        coded = v.reshape(n, size[1], width).astype(int)
        wide = np.zeros((n, size[1] + 1, width + step), int)  # a row above and samples to the left of nought
        for y in range(size[1]):
            for x in range(width):
                a, b, c = wide[:, y + 1, x], wide[:, y, x + step], wide[:, y, x]
                guess = np.choose(kinds[:, y].astype(int), [np.zeros_like(a), a, b, (a + b) // 2, _paeth(a, b, c)])
                wide[:, y + 1, x + step] = (coded[:, y, x] + guess) % 256
        return [wide[:, 1:, step:].reshape(n, -1)]

    return computed(df, [name, f"{name}_kind"], {out: "array<int>"}, make)
