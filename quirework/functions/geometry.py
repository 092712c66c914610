"""Rectangle, quad and point arithmetic as column expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

D = lambda v: F.lit(float(v))  # noqa: E731  a DOUBLE literal, never a DECIMAL

# Page sizes in points, in matching order.
PAGE_PRESETS = [("letter", 612.0, 792.0), ("legal", 612.0, 1008.0), ("a4", 595.0, 842.0), ("tabloid", 792.0, 1224.0)]
# Fixed values.
DEFAULT_PAGE_HEIGHT = 792.0
POINTS_PER_UNIT = {"in": 72.0, "cm": 28.346, "pt": 1.0}
# Allowed ranges of the numeric settings.
CLAMPS = {
    "print_scale": (25.0, 400.0), "stamp_size": (0.1, 2.0), "zoom": (0.25, 5.0), "draw_stroke": (1.0, 50.0),
    "highlight_stroke": (5.0, 50.0), "shape_stroke": (1.0, 20.0), "opacity": (0.0, 1.0), "arrow_head": (5.0, 30.0),
}
_QUAD_X, _QUAD_Y = (0, 2, 4, 6), (1, 3, 5, 7)


def bbox(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def rect(x, y, width, height) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def point(x, y) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def flip_bbox(x0, y0, x1, y1, page_height) -> Column:
    """Mirror a box top to bottom; the inverse of itself."""
    return bbox(x0, page_height - y1, x1, page_height - y0)


def xywh_to_bbox(x, y, width, height, page_height) -> Column:
    """Display-space ``x, y, w, h`` to a PDF-space box; an unknown page height counts as 792."""
    return flip_bbox(x, y, x + width, y + height, F.coalesce(page_height, D(DEFAULT_PAGE_HEIGHT)))


def estimate_bbox(text, x, y, size) -> Column:
    """Box for text without one: 0.6 em per character, one em high; size 12 when missing or zero."""
    em = F.coalesce(F.nullif(size, D(0)), D(12))
    return bbox(x, y, x + F.length(text) * em * D(0.6), y + em)


def normalize_rect(start_x, start_y, end_x, end_y) -> Column:
    """Drag start and end, in any direction, to a rectangle at its lower left corner."""
    x, y = F.least(start_x, end_x), F.least(start_y, end_y)
    return rect(x, y, F.greatest(start_x, end_x) - x, F.greatest(start_y, end_y) - y)


def validate_rect(y, height, page_height) -> Column:
    """``ok``, ``flipped`` or ``out_of_bounds``."""
    top = y + height
    return (
        F.when(y >= top, "flipped").when((y < 0) | (top > page_height), "out_of_bounds").otherwise("ok")
    )


def clamp(value, low, high) -> Column:
    return F.greatest(D(low), F.least(value, D(high)))


def clamp_setting(value, name) -> Column:
    return clamp(value, *CLAMPS[name])


def clamp_rect(x, y, width, height, page_width, page_height) -> Column:
    """Cut a rectangle to the page; a missing or zero size becomes 100 by 50."""
    w, h = F.coalesce(F.nullif(width, D(0)), D(100)), F.coalesce(F.nullif(height, D(0)), D(50))
    within = lambda v, top: F.greatest(D(0), F.least(v, top))
    a, b = within(y, page_height), within(y + h, page_height)
    return bbox(within(x, page_width), F.least(a, b), within(x + w, page_width), F.greatest(a, b))


def large_enough(kind, width, height, field_type=None) -> Column:
    """Whether a drawn annotation is big enough to keep.  Form fields grow to their minimum first."""
    grown_w, grown_h = field_min_size(field_type, width, height) if field_type is not None else (width, height)
    return (
        F.when(kind == "redact", (width > 10) & (height > 10))
        .when(kind == "callout", (width > 20) & (height > 20))
        .when(kind == "shape", (width >= 10) | (height >= 10))
        .when(kind == "formField", (grown_w >= 20) & (grown_h >= 20))
        .otherwise(F.lit(True))
    )


def field_min_size(field_type, width, height):
    """Fixed minimum sizes: text 100x30, dropdown 150x30, date 120x30."""
    w = (
        F.when(field_type == "text", F.greatest(width, D(100)))
        .when(field_type == "dropdown", F.greatest(width, D(150)))
        .when(field_type == "date", F.greatest(width, D(120)))
        .otherwise(width)
    )
    return w, F.when(field_type.isin("text", "dropdown", "date"), F.greatest(height, D(30))).otherwise(height)


def quad_bbox(quad) -> Column:
    xs = F.array(*[quad[i] for i in _QUAD_X])
    ys = F.array(*[quad[i] for i in _QUAD_Y])
    return F.when(
        F.size(quad) >= 8, bbox(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    )


def quads_bbox(quads) -> Column:
    """Box around all well-formed quads; null when it is empty or not finite."""
    good = F.filter(quads, lambda q: F.size(q) >= 8)
    xs = F.flatten(F.transform(good, lambda q: F.array(*[q[i] for i in _QUAD_X])))
    ys = F.flatten(F.transform(good, lambda q: F.array(*[q[i] for i in _QUAD_Y])))
    x0, y0, x1, y1 = F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
    finite = lambda v: ~F.isnan(v) & (F.abs(v) < D(math.inf))
    solid = finite(x0) & finite(y0) & finite(x1) & finite(y1) & (x0 < x1) & (y0 < y1)
    return F.when(solid, bbox(x0, y0, x1, y1))


def flip_quads(quads, page_height) -> Column:
    """Mirror quads top to bottom; a quad of fewer than eight numbers becomes zeros."""
    return F.transform(
        quads,
        lambda q: F.when(
            F.size(q) >= 8, F.array(*[(page_height - q[i]) if i % 2 else q[i] for i in range(8)])
        ).otherwise(F.array_repeat(D(0), 8)),
    )


def rect_quad(x, y, width, height) -> Column:
    return F.array(x, y, x + width, y, x + width, y + height, x, y + height)


def normalize_rotation(degrees) -> Column:
    return F.pmod(degrees, F.lit(360)).cast("int")


def add_rotation(current, degrees) -> Column:
    """Turn by ``degrees`` and settle on the nearest quarter turn."""
    total = F.pmod(F.pmod(current, F.lit(360)) + degrees, F.lit(360))
    return (F.floor(total / D(90) + D(0.5)) * 90 % 360).cast("int")


def mediabox(width, height, rotation) -> Column:
    """Unrotated page size from the displayed one."""
    turned = rotation.isin(90, 270)
    return F.struct(
        F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height")
    )


def turn_point(x, y, relative, w, h) -> Column:
    return point(
        F.when(relative == 90, h - y).when(relative == 270, y).when(relative == 180, w - x).otherwise(x),
        F.when(relative == 90, x).when(relative == 270, w - x).when(relative == 180, h - y).otherwise(y),
    )


def turn_rect(x, y, width, height, relative, w, h, mode="reference") -> Column:
    """Rectangle after turning its page; ``w``/``h`` is the unrotated page.

    ``reference`` keeps the historic rule, in which rectangles and quads turn in opposite directions;
    ``geometric`` turns the corners like quads.
    """
    ww, hh = F.coalesce(width, D(0)), F.coalesce(height, D(0))
    side = relative.isin(90, 270)
    if mode == "geometric":
        nx = F.when(relative == 90, h - y - hh).when(relative == 270, y).when(relative == 180, w - x - ww).otherwise(x)
        ny = F.when(relative == 90, x).when(relative == 270, w - x - ww).when(relative == 180, h - y - hh).otherwise(y)
    else:
        nx = F.when(relative == 90, y).when(relative == 270, h - y - hh).when(relative == 180, w - x - ww).otherwise(x)
        ny = F.when(relative == 90, w - x).when(relative == 270, x).when(relative == 180, h - y - hh).otherwise(y)
    return rect(nx, ny, F.when(side, height).otherwise(width), F.when(side, width).otherwise(height))


def turn_quads(quads, relative, w, h) -> Column:
    def one(q):
        pts = [turn_point(q[i], q[i + 1], relative, w, h) for i in (0, 2, 4, 6)]
        return F.when(F.size(q) >= 8, F.array(*[p[c] for p in pts for c in ("x", "y")])).otherwise(q)

    return F.transform(quads, one)


def canvas_to_pdf(cx, cy, width, height, rotation, scale=2.0, dpr=1.0) -> Column:
    mh = mediabox(width, height, rotation)["height"]
    return point(cx / D(scale * dpr), mh - cy / D(scale * dpr))


def pdf_to_canvas(x, y, width, height, rotation, scale=2.0) -> Column:
    """The page counts as turned when its rotation says so, or when a point lies above a wide page."""
    turned = rotation.isin(90, 270) | ((y > height) & (width > height))
    mh = F.when(turned, width).otherwise(height)
    return point(x * D(scale), (mh - y) * D(scale))


def to_points(value, unit) -> Column:
    return value * D(POINTS_PER_UNIT[unit])


def from_points(value, unit) -> Column:
    return value / D(POINTS_PER_UNIT[unit])


def classify_page_size(width, height) -> Column:
    """First preset within a tenth of an inch on both sides, else ``custom``."""
    out = None
    for name, w, h in PAGE_PRESETS:
        near = (F.abs(width / D(72) - D(w / 72)) < 0.1) & (F.abs(height / D(72) - D(h / 72)) < 0.1)
        out = F.when(near, name) if out is None else out.when(near, name)
    return out.otherwise("custom")


def orientation(width, height) -> Column:
    return F.when(width < height, "portrait").otherwise("landscape")


def is_landscape(width, height) -> Column:
    return width > height


def rotate_point(x, y, cx, cy, degrees) -> Column:
    a = degrees * D(math.pi / 180)
    dx, dy = x - cx, y - cy
    return point(cx + dx * F.cos(a) - dy * F.sin(a), cy + dx * F.sin(a) + dy * F.cos(a))


def lock_direction(sx, sy, ex, ey) -> Column:
    """Direction a shift-drag is locked to."""
    dx, dy = F.abs(ex - sx), F.abs(ey - sy)
    angle = F.atan2(dy, dx) * D(180 / math.pi)
    return (
        F.when(F.abs(angle - 45) < 10, "diagonal")
        .when(dx > dy * D(1.1), "horizontal")
        .when(dy > dx * D(1.1), "vertical")
        .when(dx > dy, "horizontal")
        .otherwise("vertical")
    )


def locked_end(sx, sy, ex, ey) -> Column:
    kind = lock_direction(sx, sy, ex, ey)
    mean = ((ex - sx) + (ey - sy)) / D(2)
    return point(
        F.when(kind == "horizontal", ex).when(kind == "vertical", sx).otherwise(sx + mean),
        F.when(kind == "horizontal", sy).when(kind == "vertical", ey).otherwise(sy + mean),
    )


def snap_angle(sx, sy, ex, ey) -> Column:
    """End of an arrow snapped to the nearest eighth turn, length kept."""
    dx, dy = ex - sx, ey - sy
    length = F.sqrt(dx * dx + dy * dy)
    step = F.floor(F.atan2(dy, dx) / D(math.pi / 4) + D(0.5)) * D(math.pi / 4)
    return point(sx + length * F.cos(step), sy + length * F.sin(step))


def square_end(sx, sy, ex, ey) -> Column:
    side = F.greatest(F.abs(ex - sx), F.abs(ey - sy))
    return point(sx + F.when(ex > sx, side).otherwise(-side), sy + F.when(ey > sy, side).otherwise(-side))


def fit_aspect(start_w, start_h, new_w, new_h, ratio, keep=True) -> Column:
    """Corner resize with sides of at least 50; the side that moved less follows the ratio."""
    w, h = F.greatest(D(50), new_w), F.greatest(D(50), new_h)
    off = F.abs(w / h - ratio) > D(0.01) if keep else F.lit(False)
    wide = F.abs(w - start_w) > F.abs(h - start_h)
    return F.struct(
        F.when(off & ~wide, h * ratio).otherwise(w).alias("width"),
        F.when(off & wide, w / ratio).otherwise(h).alias("height"),
    )


def stamp_size(pixel_w, pixel_h, multiplier) -> Column:
    """Placed size of a stamp: thumbnail pixels / 6, scaled, at least 50 by 30."""
    return F.struct(
        F.greatest(D(50), pixel_w / D(6) * multiplier).alias("width"),
        F.greatest(D(30), pixel_h / D(6) * multiplier).alias("height"),
    )


def textbox_size(sx, sy, ex, ey, font_size=12.0) -> Column:
    """Text box from a click (no or a tiny drag) or a drag; ``y`` is the top edge."""
    # A missing end coordinate counts as 0 when the end point itself is there.
    click = F.coalesce((F.abs(ex - sx) < 5) & (F.abs(ey - sy) < 5), F.lit(True))
    return F.struct(
        F.when(click, sx).otherwise(F.least(sx, ex)).alias("x"),
        F.when(click, sy).otherwise(F.greatest(sy, ey)).alias("y"),
        F.when(click, D(font_size * 9)).otherwise(F.greatest(D(50), F.abs(ex - sx))).alias("width"),
        F.when(click, D(font_size * 1.5)).otherwise(F.greatest(D(30), F.abs(ey - sy))).alias("height"),
    )


def insert_index(page, position, page_count) -> Column:
    """Insert position before/after a 1-based page; null outside the document."""
    at = page - 1 + F.when(position == "before", 0).otherwise(1)
    return F.when((at >= 0) & (at <= page_count), at).cast("int")


def clamp_range(first, last, page_count) -> Column:
    """0-based first and last page of a 1-based range, moved into the document."""
    cut = lambda v: F.least(v - 1, page_count - 1)
    a = F.greatest(F.lit(0), cut(first))
    return F.struct(a.cast("int").alias("first"), F.greatest(a, cut(last)).cast("int").alias("last"))


def intersects(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Closed intersection: touching counts."""
    return (ax1 >= bx0) & (ax0 <= bx1) & (ay1 >= by0) & (ay0 <= by1)
