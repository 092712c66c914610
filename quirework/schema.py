"""Table schemas as DDL.  Tables are keyed by ``doc_id`` and, below that, by 0-based ``page_number``.

Coordinates are PDF points with the origin at the bottom left; ``y`` of an annotation is its bottom edge.
"""

POINT = "STRUCT<x: DOUBLE, y: DOUBLE>"
POINTS = f"ARRAY<{POINT}>"
QUADS = "ARRAY<ARRAY<DOUBLE>>"

DOC = "doc_id BIGINT, name STRING, page_count INT, file_size BIGINT, last_modified TIMESTAMP, path STRING"
PAGE = "doc_id BIGINT, page_number INT, width DOUBLE, height DOUBLE, rotation INT"
SPAN = (
    "doc_id BIGINT, page_number INT, span_id BIGINT, text STRING, "
    "x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, font STRING, font_size DOUBLE"
)
STAMP_DATA = (
    "STRUCT<id: STRING, name: STRING, type: STRING, createdAt: BIGINT, text: STRING, font: STRING, "
    "textColor: STRING, imageData: STRING, imageWidth: DOUBLE, imageHeight: DOUBLE, "
    f"signaturePath: {POINTS}, borderEnabled: BOOLEAN, borderThickness: DOUBLE, borderOffset: DOUBLE, "
    "borderColor: STRING, backgroundEnabled: BOOLEAN, backgroundColor: STRING>"
)

# One annotation as found in a file, before normalisation.  ``source`` tells the annotation list
# ("list") from the page's own array ("page"), which is the only one that holds every widget.  ``y_space`` is
# "pdf" (y up) or "display" (y down); null means the habit of each subtype.
RAW_ANNOTATION = (
    "doc_id BIGINT, page_number INT, ord INT, source STRING, subtype STRING, page_height DOUBLE, "
    f"rect ARRAY<DOUBLE>, quads {QUADS}, line STRING, ink STRING, color ARRAY<DOUBLE>, "
    "interior_color ARRAY<DOUBLE>, opacity DOUBLE, border_width DOUBLE, contents STRING, flags MAP<STRING, STRING>, "
    "options ARRAY<STRING>, y_space STRING"
)

ANNOTATION = (
    "doc_id BIGINT, ann_id STRING, ord INT, type STRING, page_number INT, x DOUBLE, y DOUBLE, width DOUBLE, "
    "height DOUBLE, content STRING, color STRING, opacity DOUBLE, rotation DOUBLE, "
    f"quads {QUADS}, path {POINTS}, points {POINTS}, highlight_mode STRING, "
    f"arrow_point {POINT}, box_position {POINT}, shape_type STRING, stroke_color STRING, stroke_width DOUBLE, fill_color STRING, "
    "fill_opacity DOUBLE, arrow_head_size DOUBLE, font_size DOUBLE, font_family STRING, has_background BOOLEAN, "
    "background_color STRING, image_data STRING, image_width DOUBLE, image_height DOUBLE, "
    "preserve_aspect BOOLEAN, field_type STRING, field_name STRING, value_str STRING, value_bool BOOLEAN, "
    "options ARRAY<STRING>, required BOOLEAN, read_only BOOLEAN, multiline BOOLEAN, radio_group STRING, "
    f"stamp_id STRING, stamp {STAMP_DATA}"
)
