"""Structured-text JSON of pages to spans."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import estimate_bbox, flip_bbox

_FONT = "STRUCT<name: STRING, family: STRING, size: DOUBLE>"
# A box may be an object or an array; as STRING it is kept as text and read both ways.
_LEAF = f"text: STRING, x: DOUBLE, y: DOUBLE, bbox: STRING, font: {_FONT}"
_BLOCKS = f"ARRAY<STRUCT<type: STRING, lines: ARRAY<STRUCT<{_LEAF}, spans: ARRAY<STRUCT<{_LEAF}>>>>>>"


_NUMBER = r"(?:-?[1-9][0-9]*|0|-?0(?=\.))(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
_PLAIN_ARRAY = rf"^\[{_NUMBER}(?:,{_NUMBER})*\]\z"
_PLAIN_OBJECT = r"^\{" + ",".join(f'"{k}":{_NUMBER}' for k in "xywh") + r"\}\z"


def _box_values(bbox):
    """A box's text as an object ``x, y, w, h`` and as an array; one of them is null.

    A parser is set up for each text, which takes far longer than the reading of four numbers.  So texts that are nothing but plain
    JSON numbers in the usual form are cut at their marks, and the parser has the others.
    """
    is_obj, short = bbox.startswith("{"), F.length(bbox) <= 400
    cut = F.split(bbox, ":")
    values = [F.substring_index(F.get(cut, k), "}" if k == 4 else ",", 1).try_cast("double") for k in (1, 2, 3, 4)]
    plain = F.struct(*[v.alias(k) for k, v in zip("xywh", values)])
    obj = F.when(short & bbox.rlike(_PLAIN_OBJECT), plain).otherwise(F.from_json(bbox, "x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE"))
    listed = F.split(F.substring(bbox, F.lit(2), F.length(bbox) - 2), ",").try_cast("array<double>")
    arr = F.when(short & bbox.rlike(_PLAIN_ARRAY), listed).otherwise(F.from_json(bbox, "ARRAY<DOUBLE>"))
    return F.when(is_obj, obj), F.when(~is_obj, arr)


def _display_box(leaf, obj, arr, own):
    """Box of a line or span in display space, null when it has no position.

    A line with a too short array falls back to its point, a nested span does not.
    """
    box = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    placed = leaf["x"].isNotNull() & leaf["y"].isNotNull()
    guess = F.when(placed, estimate_bbox(leaf["text"], leaf["x"], leaf["y"], leaf["font"]["size"]))
    return (
        F.when(leaf["bbox"].isNull(), guess)
        .when(leaf["bbox"].startswith("{"), box(obj["x"], obj["y"], obj["x"] + obj["w"], obj["y"] + obj["h"]))
        .when(F.size(arr) >= 4, box(F.get(arr, 0), F.get(arr, 1), F.get(arr, 2), F.get(arr, 3)))
        .when(own, guess))


def read_structured_text(df: DataFrame, json_col="json") -> DataFrame:
    """Spans of text and paragraph blocks: one per line with text, one per nested span, in file order.

    ``df`` has ``doc_id, page_number, page_height`` and the JSON, either ``{"blocks": [...]}`` or the bare list.
    """
    blocks = F.coalesce(F.from_json(json_col, f"blocks {_BLOCKS}")["blocks"], F.from_json(json_col, _BLOCKS))
    # The outer forms: for the others Spark adds filters that parse everything a second time.  Rows without an element fall out
    # below.
    text_blocks = df.select(
        "doc_id", "page_number", "page_height", F.posexplode_outer(blocks).alias("b", "block")
    ).filter(F.col("block.type").isin("text", "paragraph"))
    lines = text_blocks.select(
        "doc_id", "page_number", "page_height", "b", F.posexplode_outer("block.lines").alias("l", "line"))
    # The line itself comes first (position 0), its spans follow.
    own = F.array(F.struct(*[F.col(f"line.{c}") for c in ("text", "x", "y", "bbox", "font")]))
    none = F.array().cast(f"array<struct<{_LEAF}>>")
    leaves = lines.select(
        "doc_id", "page_number", "page_height", "b", "l", F.posexplode_outer(F.concat(own, F.coalesce("line.spans", none))).alias("s", "leaf")
    ).filter(F.coalesce("leaf.text", F.lit("")) != "")
    leaf = F.col("leaf")
    obj, arr = _box_values(leaf["bbox"])
    parsed = leaves.select("*", obj.alias("obj"), arr.alias("arr"))
    # The box leaves an array, as a filter on a column would be pushed below and read the text of the box once more.
    box = _display_box(leaf, F.col("obj"), F.col("arr"), F.col("s") == 0)
    rows = parsed.select("*", F.explode_outer(F.array(box)).alias("box")).filter(F.col("box").isNotNull())
    d = F.col("box")
    h = F.coalesce("page_height", F.lit(792.0))
    span_id = (F.col("b").cast("long") * 1000000 + F.col("l")) * 1000000 + F.col("s")
    return rows.select(
        "doc_id", "page_number", span_id.alias("span_id"), leaf["text"].alias("text"),
        flip_bbox(d["x0"], d["y0"], d["x1"], d["y1"], h).alias("_b"),
        F.coalesce("leaf.font.name", "leaf.font.family").alias("font"), leaf["font"]["size"].alias("font_size"),
    ).select("doc_id", "page_number", "span_id", "text", "_b.*", "font", "font_size")
