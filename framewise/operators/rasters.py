"""Pictures and vectors as numpy arrays, a batch of rows at a time: shrinking, filters, bands, packed codes, products, and
picks of windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from framewise.sources.shared import Store

#: Values that are worked on at once, whatever a picture's size.
AT_ONCE = 1 << 22


def computed(df: DataFrame, inputs: list[str], outputs: dict[str, str], make: Callable) -> DataFrame:
    """``df`` with the columns ``outputs`` (name: type) that ``make`` gives for the array columns ``inputs``: it gets a
    numpy array of rows by values for each, and returns a numpy array, or a list of bytes, for each output. Rows with a null
    input, or a null among its values, have null outputs; arrays of one column must be equally long."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, _parse_datatype_string(t)) for n, t in outputs.items()]])
    kinds = [to_arrow_type(_parse_datatype_string(t)) for t in outputs.values()]

    def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ok = ~np.asarray(column.is_null())
        sizes = np.diff(np.asarray(column.offsets))
        width = int(sizes[ok][0]) if ok.any() else 0
        if (sizes[ok] != width).any():
            raise ValueError(f"arrays of {sorted({*sizes[ok].tolist()})[:5]} values in one column")
        found = np.full((len(column), width), np.nan)
        if width:
            found[ok] = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        return found, ok & ~np.isnan(found).any(1) if width else ok

    def arrow(rows, ok: np.ndarray, kind: pa.DataType) -> pa.Array:
        out = [None] * len(ok)
        for i, row in zip(np.flatnonzero(ok).tolist(), rows, strict=True):
            out[i] = row
        return pa.array(out, kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matrix(batch.column(c)) for c in inputs]
            ok = np.logical_and.reduce([k for _, k in found])
            step = max(1, AT_ONCE // max(1, max(m.shape[1] for m, _ in found)))
            whole = [[] for _ in outputs]
            at = np.flatnonzero(ok)
            for i in range(0, len(at), step):
                for kept, part in zip(whole, make(*[m[at[i : i + step]] for m, _ in found]), strict=True):
                    kept += part.tolist() if isinstance(part, np.ndarray) else part
            for (name, _), kept, kind in zip(outputs.items(), whole, kinds, strict=True):
                batch = batch.append_column(name, arrow(kept, ok, kind))
            yield batch

    return df.mapInArrow(read, schema)


def cubic(x: np.ndarray, sharp: float = -0.5) -> np.ndarray:
    """The Catmull-Rom kernel."""
    x = np.abs(x)
    near = ((sharp + 2) * x - (sharp + 3)) * x * x + 1
    far = ((sharp * x - 5 * sharp) * x + 8 * sharp) * x - 4 * sharp
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def resampling(size: int, to: int) -> np.ndarray:
    """Weights of ``size`` places for each of ``to``: the kernel, widened by the ratio when there are fewer, around the
    centre of each place; those that fall outside are left out and the rest add up to one."""
    ratio = size / to
    wide = max(ratio, 1.0)
    centre = (np.arange(to) + 0.5) * ratio
    low = np.maximum((centre - 2 * wide + 0.5).astype(int), 0)
    high = np.minimum((centre + 2 * wide + 0.5).astype(int), size)
    at = np.arange(size)
    weight = cubic((at[None, :] - centre[:, None] + 0.5) / wide)
    weight[(at[None, :] < low[:, None]) | (at[None, :] >= high[:, None])] = 0.0
    return weight / weight.sum(1, keepdims=True)


def shrunk(df: DataFrame, name: str, out: str, size: tuple[int, int], to: tuple[int, int], channels: int = 1) -> DataFrame:
    """Adds ``out``: pictures of ``size`` (width, height), unit-range samples row by row with their channels together, in
    another size, as codes from 0 to 255, half to even. Samples beyond the range are clipped after the resampling, a sample
    that is no number is an error."""
    across, down = resampling(size[0], to[0]), resampling(size[1], to[1])

    def make(v: np.ndarray) -> list[np.ndarray]:
        if not np.isfinite(v).all():
            raise ValueError(f"{name} has samples that are no numbers")
        small = np.einsum("yj,njic,xi->nyxc", down, v.reshape(len(v), size[1], size[0], channels), across, optimize=True)
        return [np.clip(np.rint(small * 255), 0, 255).astype(int).reshape(len(v), to[0] * to[1] * channels)]

    return computed(df, [name], {out: "array<int>"}, make)


def _kernel(v: np.ndarray, kernel: tuple[float, ...], gap: int, edge: str) -> np.ndarray:
    """Pictures (rows, height, width) through a kernel along both sides, its taps ``gap`` places apart."""
    reach = len(kernel) // 2 * gap
    for axis in (2, 1):
        wide = np.pad(v, [(0, 0)] + [(reach if a == axis else 0,) * 2 for a in (1, 2)], mode=edge)
        n = v.shape[axis]
        v = sum(w * np.take(wide, np.arange(k * gap, k * gap + n), axis) for k, w in enumerate(kernel))
    return v


def low_band(v: np.ndarray, levels: int) -> np.ndarray:
    """The à-trous cascade: at each level 1-2-1 weights twice as far apart, edges repeated."""
    for level in range(levels):
        v = _kernel(v, (0.25, 0.5, 0.25), 1 << level, "edge")
    return v


def transferred(df: DataFrame, content: str, style: str, out: str, size: tuple[int, int], levels: int) -> DataFrame:
    """Adds ``out``: the fine detail of ``content`` on the low band of ``style``."""

    def make(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        a, b = (x.reshape(-1, size[1], size[0]) for x in (a, b))
        return [(a - low_band(a, levels) + low_band(b, levels)).reshape(len(a), size[0] * size[1])]

    return computed(df, [content, style], {out: "array<double>"}, make)


def quality(df: DataFrame, a: str, b: str, size: tuple[int, int], kernel: tuple[float, ...], peak: float = 255.0, box: int = 9) -> DataFrame:
    """Adds ssim, mean structural similarity of two pictures by the kernel; and of ``a``: laplacian, the variance of the sum
    of a place's four neighbours less four times itself, and deviation, the mean standard deviation within a square of
    ``box``. Pictures are mirrored at their edges."""
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    if max(len(kernel), box) // 2 >= min(size):
        raise ValueError(f"pictures of {size} are too small for a kernel of {max(len(kernel), box)}")

    def make(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        x, y = (v.reshape(-1, size[1], size[0]) for v in (x, y))
        mx, my, xx, yy, xy = (_kernel(v, kernel, 1, "reflect") for v in (x, y, x * x, y * y, x * y))
        same = (2 * mx * my + c1) * (2 * (xy - mx * my) + c2) / ((mx * mx + my * my + c1) * (xx - mx * mx + yy - my * my + c2))
        wide = np.pad(x, [(0, 0), (1, 1), (1, 1)], mode="reflect")
        lap = wide[:, 1:-1, :-2] + wide[:, 1:-1, 2:] + wide[:, :-2, 1:-1] + wide[:, 2:, 1:-1] - 4 * x
        square = (1.0 / box,) * box
        spread = np.sqrt(np.maximum(_kernel(x * x, square, 1, "reflect") - _kernel(x, square, 1, "reflect") ** 2, 0))
        return [same.mean((1, 2)), lap.var((1, 2)), spread.mean((1, 2))]

    return computed(df, [a, b], {"ssim": "double", "laplacian": "double", "deviation": "double"}, make)


def rotated(df: DataFrame, name: str, out: str) -> DataFrame:
    """Adds ``out``: the Walsh-Hadamard transform of 2 ** k values over its root, in k passes of sums and differences."""

    def make(v: np.ndarray) -> list[np.ndarray]:
        n, half = v.shape[1], 1
        if n & (n - 1) or not n:
            raise ValueError(f"{n} values are no power of two")
        while half < n:
            pair = v.reshape(len(v), n // (2 * half), 2, half)
            v = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(len(v), n)
            half *= 2
        return [v / math.sqrt(n)]

    return computed(df, [name], {out: "array<double>"}, make)


def packed(df: DataFrame, name: str, out: str, bits: int, block: int) -> DataFrame:
    """Adds ``out``: values as codes of ``bits`` bits, lowest bit first, packed without gaps, and ``<out>_scale`` and
    ``<out>_least``: a block's values are code * scale + least. Lengths are multiples of the block."""
    most = (1 << bits) - 1

    def make(v: np.ndarray) -> list:
        each = v.reshape(len(v), -1, block)
        least = each.min(2)
        scale = (each.max(2) - least) / most
        codes = np.rint((each - least[:, :, None]) / np.where(scale == 0, 1.0, scale)[:, :, None]).astype(np.uint8)
        flat = (codes.reshape(len(v), -1, 1) >> np.arange(bits) & 1).reshape(len(v), -1).astype(np.uint8)
        return [[row.tobytes() for row in np.packbits(flat, 1, bitorder="little")], scale, least]

    return computed(df, [name], {out: "binary", f"{out}_scale": "array<double>", f"{out}_least": "array<double>"}, make)


def unpacked(df: DataFrame, name: str, out: str, bits: int, block: int) -> DataFrame:
    """Adds ``out``, the values that ``packed`` codes in ``name`` stand for, and ``<out>_codes``. A text of codes that does
    not hold as many as the blocks have is an error."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType())), T.StructField(f"{out}_codes", T.ArrayType(T.IntegerType()))])
    weights = 1 << np.arange(bits)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, codes = [], []
            for raw, scale, least in zip(*[batch.column(c).to_pylist() for c in (name, f"{name}_scale", f"{name}_least")], strict=True):
                if raw is None or scale is None or least is None:
                    values.append(None), codes.append(None)
                    continue
                n = len(scale) * block
                if len(raw) != -(-n * bits // 8):
                    raise ValueError(f"{len(raw)} bytes, where {n} codes of {bits} bits take {-(-n * bits // 8)}")
                found = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits) @ weights
                codes.append(found)
                values.append((found.reshape(-1, block) * np.array(scale)[:, None] + np.array(least)[:, None]).reshape(-1))
            yield batch.append_column(out, pa.array(values, pa.list_(pa.float64()))).append_column(f"{out}_codes", pa.array(codes, pa.list_(pa.int32())))

    return df.mapInArrow(read, schema)


def product(a: DataFrame, b: DataFrame, row: str, column: str, codes: str, block: int = 1024, depth: int = 256) -> DataFrame:
    """(<row>, <column>, value): the products of all integer vectors of ``a(<row>, codes)`` with all of ``b(<column>,
    codes)``, which are equally long and whose keys are long. Rows, columns and depth are dealt in blocks; a task multiplies
    one block of rows by one of columns over one of the depth in whole numbers, and the parts are summed."""
    kind = "long"
    deal = lambda df, key, name: df.withColumn(name, F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.lit(-(-df.count() // block)))))
    left, right = deal(a, row, "_r"), deal(b, column, "_c")
    n = {name: max(1, -(-df.count() // block)) for name, df in (("_r", a), ("_c", b))}
    cut = lambda df: df.withColumn("_d", F.explode(F.expr(f"sequence(0, greatest(cast(ceil(size({codes}) / {depth}.0) as int) - 1, 0))"))).withColumn(codes, F.expr(f"slice({codes}, _d * {depth} + 1, {depth})"))
    every = lambda df, name: df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n[name] - 1).cast("long"))))
    left, right = every(cut(left.select(row, codes, "_r")), "_c"), every(cut(right.select(column, codes, "_c")), "_r")

    def multiplied(x: pa.Table, y: pa.Table) -> pa.Table:
        rows, columns = x.column(row).to_numpy(), y.column(column).to_numpy()
        if not len(rows) or not len(columns):
            return pa.table({"row": pa.array([], pa.int64()), "column": pa.array([], pa.int64()), "part": pa.array([], pa.int64())})
        of = lambda t: np.array(t.column(codes).to_pylist(), np.int64)
        part = of(x) @ of(y).T
        return pa.table({"row": np.repeat(rows, len(columns)), "column": np.tile(columns, len(rows)), "part": part.reshape(-1)})

    parts = left.groupBy("_r", "_c", "_d").cogroup(right.groupBy("_r", "_c", "_d")).applyInArrow(multiplied, f"row {kind}, column {kind}, part long")
    return parts.groupBy(F.col("row").alias(row), F.col("column").alias(column)).agg(F.sum("part").alias("value"))


def window_scores(maps: DataFrame, key: str, name: str, size: tuple[int, int], window: tuple[int, int], step: int) -> DataFrame:
    """(<key>, x, y, score): the mean of a map over each window of a grid, by sums over all above and left of a corner."""

    def make(v: np.ndarray) -> list[np.ndarray]:
        total = np.zeros((len(v), size[1] + 1, size[0] + 1))
        total[:, 1:, 1:] = v.reshape(-1, size[1], size[0]).cumsum(1).cumsum(2)
        y, x = np.arange(0, size[1] - window[1] + 1, step)[:, None], np.arange(0, size[0] - window[0] + 1, step)[None, :]
        s = total[:, y + window[1], x + window[0]] - total[:, y, x + window[0]] - total[:, y + window[1], x] + total[:, y, x]
        return [(s / (window[0] * window[1])).reshape(len(v), -1)]

    across = len(range(0, size[0] - window[0] + 1, step))
    each = computed(maps.select(key, name), [name], {"_scores": "array<double>"}, make).select(key, F.posexplode("_scores").alias("_i", "score"))
    return each.select(key, (F.col("_i") % across * step).cast("long").alias("x"), (F.floor(F.col("_i") / across) * step).cast("long").alias("y"), "score")


def apart(windows: DataFrame, key: str, window: tuple[int, int], store: Store) -> DataFrame:
    """The rows of ``windows(<key>, x, y, score)`` that a greedy choice takes: the best first (ties by y, then x), each if
    it overlaps none taken before. In a round every window that is better than all that overlap it is taken, all at once,
    and what overlaps it goes; the best one left always is, so each round ends some, and the choice is the same. The best
    around a window is the best of the bests along its rows: two sliding windows, and never a pair of windows. So windows
    must lie on a whole grid of places, those without a score with a null one."""
    x = Window.partitionBy(key, "y").orderBy("x").rangeBetween(-window[0] + 1, window[0] - 1)
    y = Window.partitionBy(key, "x").orderBy("y").rangeBetween(-window[1] + 1, window[1] - 1)
    around = lambda df, value, out: df.withColumn("_along", F.max(value).over(x)).withColumn(out, F.max("_along").over(y)).drop("_along")
    left, taken = windows.select(key, "x", "y", "score"), []
    own = F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("y")).alias("up"), (-F.col("x")).alias("left")))
    left = store.stage(left.withColumn("_own", own), "windows")
    while not left.where("_own is not null").isEmpty():
        best = around(left, "_own", "_best").withColumn("_taken", (F.col("_own") == F.col("_best")).cast("int"))
        judged = store.stage(around(best, "_taken", "_gone"), "judged")
        taken.append(judged.where("_taken = 1").select(key, "x", "y", "score"))
        # what is gone stays in its place without a score: the second window needs it to see along other rows
        left = store.stage(judged.withColumn("_own", F.when(F.coalesce("_gone", F.lit(0)) == 0, F.col("_own"))).drop("_best", "_taken", "_gone"), "left")
    out = taken[0] if taken else windows.select(key, "x", "y", "score").limit(0)
    for more in taken[1:]:
        out = out.unionByName(more)
    return out
