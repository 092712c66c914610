"""Raw annotation records to typed rows and back."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..functions import geometry as g
from ..functions.paths import parse_points, path_bbox
from ..functions.values import HIGHLIGHT_COLOR, STROKE_COLOR, color_array_to_hex, hex_to_rgb, html_to_text
from ..operators.annotations import dedupe_widgets
from ..plans.settle import settle
from ..schema import ANNOTATION, POINT, QUADS, STAMP_DATA

CONTENTS = (
    "type STRING, imageData STRING, imageWidth DOUBLE, imageHeight DOUBLE, preserveAspectRatio BOOLEAN, rotation DOUBLE, "
    f"content STRING, boxPosition {POINT}, arrowPoint {POINT}, width DOUBLE, height DOUBLE, fontSize DOUBLE, "
    f"fontFamily STRING, color STRING, stampData {STAMP_DATA}"
)
# Fixed values.
CLEAR_BACKGROUND = "rgba(255, 255, 255, 0)"
ARTIFACT_EDGE, ARTIFACT_SPAN, COORDINATE_LIMIT = 200, 150, 100000


def _flag(name):
    return F.try_element_at("flags", F.lit(name))


def _number(name):
    return _flag(name).try_cast("double")


def _or(value, default):
    """``value || default``: zero and missing both give the default."""
    return F.coalesce(F.nullif(value, F.lit(0.0)), default)


def annotation_id(*parts):
    """Stable id from the record's place and content."""
    return F.sha2(F.concat_ws("_", *[p.cast("string") for p in parts]), 256)


def parse_contents(contents):
    return F.from_json(contents, CONTENTS)


def is_stamp(parsed):
    """Contents that carry a complete stamp."""
    s = parsed["stampData"]
    whole = [F.coalesce(s[k], F.lit("")) != "" for k in ("id", "name", "type")]
    return F.coalesce((parsed["type"] == "stamp") & whole[0] & whole[1] & whole[2], F.lit(False))


def load_annotations(raw: DataFrame, merge_widgets=True) -> DataFrame:
    """Typed annotations in PDF space from raw records; one pass over the records.

    Unknown subtypes and incomplete records drop out.  Widgets of the page array join those of the annotation list
    unless one is within 1 pt (``merge_widgets``); only the widgets are compared, so only they are written in between.
    """
    names = [part.strip().split(" ")[0] for part in _top_level(ANNOTATION)]
    if not merge_widgets:
        return _typed(raw).select(names)
    is_widget = F.col("subtype") == "Widget"
    widgets = settle(_typed(raw.filter(is_widget)).select("source", *names))
    second = F.coalesce(F.col("source") == "page", F.lit(False))
    merged = dedupe_widgets(widgets.filter(~second).select(names), widgets.filter(second).select(names))
    return _typed(raw.filter(~is_widget)).select(names).unionByName(merged)


def _typed(raw: DataFrame) -> DataFrame:
    h = F.col("page_height")
    # Parsing once per record; every column below refers to these.
    r = raw.withColumns({
        "_c": parse_contents(F.col("contents")),
        "_has_rect": F.size("rect") >= 4,
        "_ink": parse_points(F.col("ink")),
        "_line": F.slice(parse_points(F.col("line")), 1, 2),
        "_display": F.col("y_space") == "display",
        "_pdf": F.col("y_space") == "pdf",
        "_quads": F.when(F.coalesce(F.col("y_space") == "pdf", F.lit(False)), F.col("quads")).otherwise(
            g.flip_quads(F.col("quads"), h)),
    })
    sub, c, no = F.col("subtype"), F.col("_c"), F.lit(False)
    has_rect = F.coalesce("_has_rect", no)
    custom = F.coalesce(fields.strip_slash(_flag("CustomAnnotation")) == "true", no)
    stamp = sub.isin("Stamp", "FreeText") & is_stamp(c)
    free = (sub == "FreeText") & ~stamp
    overlay = F.coalesce(fields.strip_slash(_flag("BM")) == "Multiply", no)

    line = F.col("_line")
    sound = (F.size(line) == 2) & F.forall(
        line, lambda p: (F.abs(p["x"]) < COORDINATE_LIMIT) & (F.abs(p["y"]) < COORDINATE_LIMIT))
    lb = path_bbox(line)
    artifact = (
        (lb["x1"] < ARTIFACT_EDGE) & (lb["y1"] < ARTIFACT_EDGE)
        & (lb["x1"] - lb["x0"] < ARTIFACT_SPAN) & (lb["y1"] - lb["y0"] < ARTIFACT_SPAN))
    arrow = (sub == "Line") & sound & ~artifact

    # Only a record without quads takes its box from the rectangle.
    has_quads = F.coalesce(F.size("quads") > 0, no) & F.col("quads").isNotNull()
    rect_box = F.when(
        has_rect & (F.get("rect", 0) < F.get("rect", 2)) & (F.get("rect", 1) < F.get("rect", 3)),
        g.bbox(F.get("rect", 0), F.get("rect", 1), F.get("rect", 2), F.get("rect", 3)))
    r = r.withColumn("_hb", F.when(has_quads, g.quads_bbox(F.col("_quads"))).otherwise(rect_box))
    highlight = (sub == "Highlight") & F.col("_hb").isNotNull()
    ink = (sub == "Ink") & (F.size("_ink") >= 2)

    kind = (
        F.when(highlight, "highlight")
        .when((sub == "Redact") & has_rect, "redact")
        .when((sub == "Widget") & has_rect, "formField")
        .when(stamp & has_rect, "stamp")
        .when(free & has_rect & (c["type"] == "image") & (F.coalesce(c["imageData"], F.lit("")) != ""), "image")
        .when(free & has_rect & (c["type"] == "callout"), "callout")
        .when(free & has_rect & custom, "text")
        .when(arrow, "arrow")
        .when(sub.isin("Square", "Circle") & has_rect, "box")
        .when(ink & overlay, "overlay")
        .when(ink, "draw")
    )
    r = r.withColumn("_kind", kind).filter(F.col("_kind").isNotNull())
    k = F.col("_kind")
    is_ = lambda *names: k.isin(*names)

    flipped = F.when(F.coalesce("_pdf", no), F.col("_ink")).otherwise(
        F.transform("_ink", lambda p: g.point(p["x"], h - p["y"])))
    line_pdf = F.when(F.coalesce("_display", no), F.transform("_line", lambda p: g.point(p["x"], h - p["y"]))).otherwise(F.col("_line"))
    ib, ab = path_bbox(flipped), path_bbox(line_pdf)
    # Lower edge of the rectangle: some subtypes are read in display space, the others in PDF space.
    by_habit = is_("stamp", "box", "text") | (is_("formField") & (F.coalesce("source", F.lit("list")) == "list"))
    display = F.coalesce("_display", F.when(F.coalesce("_pdf", no), no), by_habit)
    low = F.when(display, h - F.get("rect", 3)).otherwise(F.get("rect", 1))
    rw, rh = F.get("rect", 2) - F.get("rect", 0), F.get("rect", 3) - F.get("rect", 1)
    flip_point = lambda p: F.when(p.isNotNull(), g.point(p["x"], F.when(F.coalesce("_pdf", no), p["y"]).otherwise(h - p["y"])))
    box, tip = flip_point(c["boxPosition"]), flip_point(c["arrowPoint"])

    def by_kind(**cases):
        out = None
        for names, value in cases.items():
            cond = is_(*names.split("__"))
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return out

    def corner(hb, rect_value, arrow_value, ink_value, callout_value):
        return by_kind(highlight=hb, arrow=arrow_value, overlay__draw=ink_value, callout=callout_value).otherwise(rect_value)

    hb = F.col("_hb")
    field = fields.field_type(_flag("FT"), _flag("Ff").try_cast("int"), F.col("_name"))
    bits = fields.decode_field_flags(_flag("FT"), _flag("Ff").try_cast("int"))
    literal = lambda name: fields.strip_parens(_flag(name))
    meaningful = lambda v: F.when(~F.coalesce(v, F.lit("")).isin("", "null", "undefined"), v)
    r = r.withColumn("_name", F.coalesce(meaningful(literal("T")), meaningful(literal("ParentT")), F.lit("")))
    toggles = field.isin("checkbox", "radio")
    background = literal("BackgroundColor")
    stroke = color_array_to_hex(F.col("color"), STROKE_COLOR)
    fill = F.when(F.size("interior_color") >= 3, color_array_to_hex(F.col("interior_color"), STROKE_COLOR))
    html = F.coalesce(literal("HTMLContent"), F.col("contents"))

    cols = {
        "ann_id": annotation_id(F.col("doc_id"), F.col("page_number"), F.col("source"), sub, F.col("rect"), F.col("ord")),
        "ord": F.col("ord"),
        "type": by_kind(arrow__box=F.lit("shape"), overlay=F.lit("highlight")).otherwise(k),
        "x": corner(hb["x0"], F.get("rect", 0), ab["x0"], ib["x0"], F.coalesce(F.nullif(box["x"], F.lit(0.0)), F.get("rect", 0))),
        "y": corner(hb["y0"], low, ab["y0"], ib["y0"], F.coalesce(box["y"], low)),
        "width": corner(hb["x1"] - hb["x0"], rw, ab["x1"] - ab["x0"], ib["x1"] - ib["x0"], _or(c["width"], rw)),
        "height": corner(hb["y1"] - hb["y0"], rh, ab["y1"] - ab["y0"], ib["y1"] - ib["y0"], _or(c["height"], rh)),
        "content": by_kind(
            highlight=F.coalesce("contents", F.lit("")), text=html,
            callout=F.coalesce(F.nullif(c["content"], F.lit("")), F.col("contents"))),
        "color": by_kind(
            highlight=color_array_to_hex(F.col("color"), HIGHLIGHT_COLOR), text=F.lit(STROKE_COLOR),
            callout=F.coalesce(F.nullif(c["color"], F.lit("")), F.lit(STROKE_COLOR)), overlay__draw=stroke),
        "opacity": by_kind(
            highlight=F.coalesce("opacity", F.lit(0.5)), overlay=F.coalesce("opacity", _number("CA"), F.lit(0.5))),
        "rotation": by_kind(image=F.coalesce(c["rotation"], F.lit(0.0))),
        "quads": by_kind(highlight=F.when(has_quads, F.col("_quads"))),
        "path": by_kind(overlay__draw=flipped),
        "points": by_kind(arrow=line_pdf),
        "highlight_mode": by_kind(highlight=F.lit("text"), overlay=F.lit("overlay")),
        "arrow_point": by_kind(callout=tip),
        "box_position": by_kind(callout=box),
        "shape_type": by_kind(arrow=F.lit("arrow"), box=F.when(sub == "Square", "rectangle").otherwise("circle")),
        "stroke_color": by_kind(arrow__box=stroke),
        "stroke_width": by_kind(
            arrow__box=_or(F.col("border_width"), F.lit(2.0)), overlay__draw=_or(F.col("border_width"), F.lit(3.0))),
        "fill_color": by_kind(box=fill),
        "fill_opacity": by_kind(box=F.when(fill.isNotNull(), F.coalesce("opacity", F.lit(0.5)))),
        "arrow_head_size": by_kind(arrow=F.coalesce(_number("ArrowHeadSize"), F.lit(10.0))),
        "font_size": by_kind(text=F.lit(12.0), callout=_or(c["fontSize"], F.lit(12.0))),
        "font_family": by_kind(text=F.lit("Arial"), callout=F.coalesce(F.nullif(c["fontFamily"], F.lit("")), F.lit("Arial"))),
        "has_background": by_kind(text=F.coalesce(fields.strip_slash(_flag("HasBackground")) == "true", F.lit(True))),
        "background_color": by_kind(text=F.when(
            F.trim(F.coalesce(background, F.lit(""))).isin("", "null", "undefined"), CLEAR_BACKGROUND
        ).otherwise(F.regexp_replace(background, r"\\([()\\])", "$1"))),
        "image_data": by_kind(image=c["imageData"]),
        "image_width": by_kind(image=_or(F.coalesce(_number("ImageWidth"), c["imageWidth"]), F.lit(200.0))),
        "image_height": by_kind(image=_or(F.coalesce(_number("ImageHeight"), c["imageHeight"]), F.lit(200.0))),
        "preserve_aspect": by_kind(image=F.coalesce(c["preserveAspectRatio"], F.lit(True))),
        "field_type": by_kind(formField=field),
        "field_name": by_kind(formField=F.col("_name")),
        "value_str": by_kind(formField=F.when(~toggles, F.coalesce(meaningful(literal("V")), F.lit("")))),
        "value_bool": by_kind(formField=F.when(toggles, fields.field_bool(_flag("V"), _flag("AS")))),
        "options": by_kind(formField=F.when((field == "dropdown") & (F.size("options") > 0), F.col("options"))),
        "required": by_kind(formField=bits["required"]),
        "read_only": by_kind(formField=bits["read_only"]),
        "multiline": by_kind(formField=bits["multiline"]),
        "radio_group": by_kind(formField=F.when((field == "radio") & (F.col("_name") != ""), F.col("_name"))),
        "stamp_id": by_kind(stamp=c["stampData"]["id"]),
        "stamp": by_kind(stamp=c["stampData"]),
    }
    return r.select("doc_id", "page_number", "source", *[v.alias(n) for n, v in cols.items()])


def _top_level(ddl):
    """Column definitions of a DDL string."""
    out, depth = [""], 0
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append("")
        else:
            out[-1] += ch
    return out


def detect_fields(raw: DataFrame) -> DataFrame:
    """Form fields of raw records: type by FT and flags, name, value; flags are not decoded further."""
    w = raw.filter((F.col("subtype") == "Widget") & (F.size("rect") >= 4))
    ft, ff = _flag("FT"), _flag("Ff").try_cast("int")
    name = F.coalesce(fields.strip_parens(_flag("T")), F.lit(""))
    kind = fields.field_type(ft, ff, name)
    toggles = kind.isin("checkbox", "radio")
    return w.select(
        "doc_id", "page_number", "ord", name.alias("field_name"), kind.alias("field_type"),
        F.when(~toggles, F.coalesce(fields.strip_parens(_flag("V")), F.lit(""))).alias("value_str"),
        F.when(toggles, fields.field_bool(_flag("V"), _flag("AS"))).alias("value_bool"),
        F.get("rect", 0).alias("x"), F.get("rect", 1).alias("y"),
        (F.get("rect", 2) - F.get("rect", 0)).alias("width"), (F.get("rect", 3) - F.get("rect", 1)).alias("height"))


def to_raw(annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """Raw records for typed annotations, with the defaults of the write side; ``load_annotations`` reads them back."""
    a = annotations.join(pages.select("doc_id", "page_number", F.col("height").alias("page_height")), ["doc_id", "page_number"])
    h, k = F.col("page_height"), F.col("type")
    overlay = (k == "highlight") & F.coalesce(F.col("highlight_mode") == "overlay", F.lit(False))
    mark = (k == "highlight") & ~overlay
    ink = (k == "draw") | overlay
    fallback = lambda text, image, callout, mark_, rest: (
        F.when(k == "text", text).when(k == "image", image).when(k == "callout", callout).when(mark, mark_).otherwise(rest))
    w = F.coalesce(F.nullif("width", F.lit(0.0)), fallback(*map(F.lit, (100.0, 200.0, 150.0, 10.0, 100.0))))
    t = F.coalesce(F.nullif("height", F.lit(0.0)), fallback(*map(F.lit, (50.0, 200.0, 80.0, 10.0, 50.0))))
    box = F.when(k == "callout", F.coalesce("box_position", g.point(F.col("x") + 50, F.col("y") - 50)))
    x, y = F.when(k == "callout", box["x"]).otherwise(F.col("x")), F.when(k == "callout", box["y"]).otherwise(F.col("y"))
    display = k.isin("text", "stamp", "formField", "callout") | F.coalesce(F.col("shape_type") != "arrow", F.lit(False))
    rect = F.when(display, F.array(x, h - y - t, x + w, h - y)).otherwise(F.array(x, y, x + w, y + t))
    arrow = F.coalesce(F.col("shape_type") == "arrow", F.lit(False))

    subtype = (
        F.when(ink, "Ink").when(mark, "Highlight").when(k == "redact", "Redact").when(k == "formField", "Widget")
        .when(k == "stamp", "Stamp").when(arrow, "Line").when(F.col("shape_type") == "rectangle", "Square")
        .when(F.col("shape_type") == "circle", "Circle").otherwise("FreeText"))
    quads = F.coalesce("quads", F.array(g.rect_quad(F.col("x"), F.col("y"), w, t)))
    flat = lambda pts, f: F.to_json(F.array(F.flatten(F.transform(pts, f))))
    rgb = lambda c, d: hex_to_rgb(F.coalesce(F.nullif(c, F.lit("")), F.lit(d)))
    three = lambda s: F.array(s["r"], s["g"], s["b"])
    flip = lambda p: F.when(p.isNotNull(), g.point(p["x"], h - p["y"]))
    contents = (
        F.when(k == "image", F.to_json(F.struct(
            F.lit("image").alias("type"), F.col("image_data").alias("imageData"), F.col("image_width").alias("imageWidth"),
            F.col("image_height").alias("imageHeight"), F.coalesce("preserve_aspect", F.lit(True)).alias("preserveAspectRatio"),
            F.coalesce("rotation", F.lit(0.0)).alias("rotation"))))
        .when(k == "callout", F.to_json(F.struct(
            F.lit("callout").alias("type"), F.coalesce("content", F.lit("")).alias("content"), flip(box).alias("boxPosition"),
            flip(F.col("arrow_point")).alias("arrowPoint"), w.alias("width"), t.alias("height"),
            F.coalesce("font_size", F.lit(12.0)).alias("fontSize"), F.coalesce("font_family", F.lit("Arial")).alias("fontFamily"),
            F.coalesce("color", F.lit(STROKE_COLOR)).alias("color"))))
        .when(k == "stamp", F.to_json(F.struct(F.lit("stamp").alias("type"), F.col("stamp").alias("stampData"))))
        .when(k == "text", html_to_text(F.coalesce("content", F.lit(""))))
        .when(mark, F.col("content"))
    )
    on = F.lit("true")
    field = F.col("field_type")
    toggle = F.when(F.coalesce("value_bool", F.lit(False)), "Yes").otherwise("Off")
    toggles = field.isin("checkbox", "radio")
    bits = fields.encode_field_flags(field, F.coalesce("multiline", F.lit(False)), F.coalesce("read_only", F.lit(False)),
                                     F.coalesce("required", F.lit(False)))
    written = F.nullif("value_str", F.lit(""))
    flags = (
        F.when(k == "text", F.create_map(
            F.lit("CustomAnnotation"), on, F.lit("HTMLContent"), F.col("content"),
            F.lit("HasBackground"), F.coalesce("has_background", F.lit(True)).cast("string"),
            F.lit("BackgroundColor"), F.coalesce("background_color", F.lit(CLEAR_BACKGROUND))))
        .when(k == "stamp", F.create_map(F.lit("StampAnnotation"), on))
        .when(k == "image", F.create_map(
            F.lit("ImageType"), F.lit("embedded"), F.lit("ImageWidth"), F.col("image_width").cast("string"),
            F.lit("ImageHeight"), F.col("image_height").cast("string")))
        .when(overlay, F.create_map(
            F.lit("BM"), F.lit("Multiply"), F.lit("CA"), F.coalesce("opacity", F.lit(0.5)).cast("string")))
        .when(mark, F.create_map(F.lit("BM"), F.lit("Multiply")))
        .when(arrow, F.create_map(F.lit("ArrowHeadSize"), F.coalesce("arrow_head_size", F.lit(10.0)).cast("string")))
        .when(k == "formField", F.map_filter(F.create_map(
            F.lit("FT"), F.when(toggles, "Btn").when(field == "dropdown", "Ch").otherwise("Tx"),
            F.lit("Ff"), F.when((bits > 0) | (field == "checkbox"), bits.cast("string")),
            F.lit("T"), F.when(field == "radio", F.coalesce("radio_group", "field_name")).otherwise(F.col("field_name")),
            F.lit("V"), F.when(toggles, toggle).otherwise(written),
            F.lit("DV"), F.when(field.isin("text", "date"), written),
            F.lit("AS"), F.when(toggles, toggle)), lambda _, v: v.isNotNull()))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    return a.select(
        "doc_id", "page_number", "ord", F.lit("list").alias("source"), subtype.alias("subtype"), "page_height",
        rect.alias("rect"), F.when(mark, g.flip_quads(quads, h)).cast(QUADS).alias("quads"),
        F.when(arrow, F.to_json(F.flatten(F.transform("points", lambda p: F.array(p["x"], p["y"]))))).alias("line"),
        F.when(ink, flat(F.col("path"), lambda p: F.array(p["x"], h - p["y"]))).alias("ink"),
        F.when(k == "shape", three(rgb(F.col("stroke_color"), STROKE_COLOR))).when(
            mark, three(rgb(F.col("color"), HIGHLIGHT_COLOR))).when(
            ink | (k == "callout"), three(rgb(F.col("color"), STROKE_COLOR))).alias("color"),
        F.when(F.col("fill_color").isNotNull(), three(hex_to_rgb(F.col("fill_color")))).alias("interior_color"),
        F.when(mark, F.coalesce("opacity", F.lit(0.5))).when(F.col("fill_color").isNotNull(), F.coalesce("fill_opacity", F.lit(0.5)))
        .alias("opacity"),
        F.col("stroke_width").alias("border_width"), contents.alias("contents"), flags.alias("flags"),
        F.when(field == "dropdown", F.col("options")).alias("options"), F.lit(None).cast("string").alias("y_space"))
