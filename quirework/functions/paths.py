"""Freehand paths: arrays of ``{x, y}`` points."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import POINTS
from .geometry import D, bbox, point


def path_bbox(path) -> Column:
    xs, ys = F.transform(path, lambda p: p["x"]), F.transform(path, lambda p: p["y"])
    return F.when(F.size(path) > 0, bbox(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def tail_points(path, count) -> Column:
    """Last ``count`` points of a live path."""
    return F.when(F.size(path) > count, F.slice(path, -count, count)).otherwise(path)


def _square(p, half):
    return F.array(
        p["x"] - half, p["y"] - half, p["x"] + half, p["y"] - half,
        p["x"] + half, p["y"] + half, p["x"] - half, p["y"] + half,
    )


def path_to_quads(path, width) -> Column:
    """One quad per segment, ``width`` wide across it; a point without direction becomes a square."""
    half = width / D(2)

    def segment(a, b):
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        length = F.sqrt(dx * dx + dy * dy)
        ox, oy = -dy / length * half, dx / length * half
        return F.when(length == 0, _square(a, half)).otherwise(
            F.array(a["x"] + ox, a["y"] + oy, a["x"] - ox, a["y"] - oy,
                    b["x"] - ox, b["y"] - oy, b["x"] + ox, b["y"] + oy)
        )

    n = F.size(path)
    return (
        F.when(n == 0, F.array().cast("array<array<double>>"))
        .when(n == 1, F.transform(path, lambda p: _square(p, half)))
        .otherwise(F.zip_with(F.slice(path, 1, F.greatest(n - 1, F.lit(1))), F.slice(path, 2, F.greatest(n - 1, F.lit(1))), segment))
    )


def smooth_path(path, steps=10) -> Column:
    """Catmull-Rom curve through the points, ends held, ``steps`` points per segment, end point repeated."""
    n = F.size(path)

    def blend(i, t, axis):
        at = lambda k: F.element_at(path, (k + 1).cast("int"))[axis]
        p0, p1, p2 = at(F.greatest(i - 1, F.lit(0))), at(i), at(i + 1)
        p3 = at(F.least(i + 2, n - 1))
        t2 = t * t
        t3 = t2 * t
        return D(0.5) * (
            D(2) * p1
            + (-p0 + p2) * t
            + (D(2) * p0 - D(5) * p1 + D(4) * p2 - p3) * t2
            + (-p0 + D(3) * p1 - D(3) * p2 + p3) * t3
        )

    def curve(i):
        return F.transform(
            F.sequence(F.lit(1), F.lit(steps)),
            lambda s: point(blend(i, s / D(steps), "x"), blend(i, s / D(steps), "y")),
        )

    middle = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), curve))
    return F.when(n < 3, path).otherwise(F.concat(F.slice(path, 1, 1), middle, F.slice(path, -1, 1)))


def _keep_mask(x, y, starts, ends, tolerance):
    """Points that survive simplification, for many paths at once: path ``i`` has the points ``starts[i]`` to ``ends[i] - 1``.

    A path is cut at the farthest point while that is beyond the tolerance.  All segments of a depth are measured together, and the
    work is the same as path by path.
    """
    keep = np.ones(len(x), bool)
    lo, hi = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - 1
    fresh = True
    while True:
        open_ = hi - lo > 1
        lo, hi = lo[open_], hi[open_]
        if not len(lo):
            return keep
        size = hi - lo - 1
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(lo + 1 - first, size)
        if fresh:
            keep[at], fresh = False, False
        # Plain products and sums, so that the result doesn't depend on how a library adds them up.
        rx, ry = x[hi] - x[lo], y[hi] - y[lo]
        square = rx * rx + ry * ry
        dx, dy = x[at] - np.repeat(x[lo], size), y[at] - np.repeat(y[lo], size)
        rx, ry = np.repeat(rx, size), np.repeat(ry, size)
        with np.errstate(divide="ignore", invalid="ignore"):
            along = np.clip((dx * rx + dy * ry) / np.repeat(square, size), 0, 1)
        along[np.repeat(square == 0, size)] = 0
        ox, oy = dx - along * rx, dy - along * ry
        far = np.sqrt(ox * ox + oy * oy)
        most = np.maximum.reduceat(far, first)
        tops = np.flatnonzero(far == np.repeat(most, size))
        cut = np.flatnonzero(most > tolerance)
        spot = at[tops[np.searchsorted(tops, first[cut])]]  # the first one of equally far points
        keep[spot] = True
        lo, hi = np.concatenate([lo[cut], spot]), np.concatenate([spot, hi[cut]])


def simplify_path(path, tolerance, only_above) -> Column:
    """Drop points within ``tolerance`` of the simplified line, for paths of more than ``only_above`` points.

    The subdivision has no fixed depth, so it runs as an Arrow UDF, which sees the paths beyond ``only_above`` only; one path is
    one value.
    """
    least = max(only_above, 2)

    @F.arrow_udf(POINTS)
    def simplify(paths: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(paths), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        points = paths.flatten()  # without what lies under nulls
        x, y = (pc.struct_field(points, n).to_numpy(zero_copy_only=False) for n in ("x", "y"))
        ends = np.cumsum(sizes)
        long = sizes > least
        keep = _keep_mask(x, y, (ends - sizes)[long], ends[long], tolerance)
        left = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])].astype(np.int32)
        # A null path is told by a null at its beginning.
        edges = pa.array(left, mask=np.append(pc.is_null(paths).to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(edges, points.filter(pa.array(keep)))

    return F.when(F.size(path) > least, simplify(F.when(F.size(path) > least, path))).otherwise(path)


def finite_points(path) -> Column:
    return F.filter(path, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))


def parse_points(json) -> Column:
    """Points from a JSON array: flat ``[x, y, x, y]``, pairs ``[[x, y], ...]``, or strokes of either kind."""
    flat = F.from_json(json, "array<double>")
    pairs = F.from_json(json, "array<array<double>>")
    deep = F.from_json(json, "array<array<array<double>>>")

    def from_flat(values):
        n = F.floor(F.size(values) / 2).cast("int")
        return F.when(n > 0, F.transform(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
            lambda i: point(F.get(values, (i * 2).cast("int")), F.get(values, (i * 2 + 1).cast("int"))),
        )).otherwise(F.array().cast(POINTS))

    def from_pairs(values):
        return F.transform(F.filter(values, lambda p: F.size(p) >= 2), lambda p: point(F.get(p, 0), F.get(p, 1)))

    # A pair is a flat stroke of one point, so two levels need no further distinction.
    opening = F.regexp_replace(F.regexp_extract(json, r"^([\s\[]*)", 1), r"\s", "")
    depth = F.length(opening)
    out = (
        F.when(depth == 1, from_flat(flat))
        .when(depth == 2, F.flatten(F.transform(pairs, from_flat)))
        .when(depth == 3, from_pairs(F.flatten(deep)))
    )
    return finite_points(F.coalesce(out, F.array().cast(POINTS)))
