"""The scalar functions as temporary SQL functions, which Catalyst inlines."""

from pyspark.sql import SparkSession

_BOX = "STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"
_BOX_ARGS = "x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"

FUNCTIONS = {
    "flip_bbox": (f"{_BOX_ARGS}, h DOUBLE", _BOX, "named_struct('x0', x0, 'y0', h - y1, 'x1', x1, 'y1', h - y0)"),
    "estimate_bbox": (
        "t STRING, x DOUBLE, y DOUBLE, size DOUBLE", _BOX,
        "named_struct('x0', x, 'y0', y, 'x1', x + length(t) * coalesce(nullif(size, 0D), 12D) * 0.6D, "
        "'y1', y + coalesce(nullif(size, 0D), 12D))"),
    "boxes_touch": (
        f"{_BOX_ARGS}, bx0 DOUBLE, by0 DOUBLE, bx1 DOUBLE, by1 DOUBLE", "BOOLEAN",
        "x1 >= bx0 AND x0 <= bx1 AND y1 >= by0 AND y0 <= by1"),
    "clamp_to": ("v DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "greatest(low, least(v, high))"),
    "normalize_rotation": ("degrees INT", "INT", "pmod(degrees, 360)"),
    "add_rotation": (
        "cur INT, degrees INT", "INT", "cast(floor(pmod(pmod(cur, 360) + degrees, 360) / 90D + 0.5D) * 90 % 360 AS INT)"),
    "points_to_inches": ("v DOUBLE", "DOUBLE", "v / 72D"),
    "points_to_cm": ("v DOUBLE", "DOUBLE", "v / 28.346D"),
    "inches_to_points": ("v DOUBLE", "DOUBLE", "v * 72D"),
    "cm_to_points": ("v DOUBLE", "DOUBLE", "v * 28.346D"),
    "page_orientation": ("w DOUBLE, h DOUBLE", "STRING", "CASE WHEN w < h THEN 'portrait' ELSE 'landscape' END"),
    "rgb_to_hex": (
        "r DOUBLE, g DOUBLE, b DOUBLE", "STRING",
        "concat('#', " + ", ".join(
            f"lower(lpad(hex(cast(floor({c} * 255D + 0.5D) AS BIGINT)), 2, '0'))" for c in "rgb") + ")"),
    "html_to_text": (
        "html STRING", "STRING",
        r"replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', '\n'), '<[^>]*>', ''), "
        r"""'&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"')"""),
}


def register_functions(spark: SparkSession, prefix="") -> list[str]:
    """Create the functions in the session; returns their names."""
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {result} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]
