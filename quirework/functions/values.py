"""Colours, labels, file names, HTML and data URLs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import D

# Fixed values.
HIGHLIGHT_COLOR, STROKE_COLOR = "#FFFF00", "#000000"
BYTE_UNITS = ["B", "KB", "MB", "GB"]


def _rgb(r, g, b):
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))


def hex_to_rgb(color) -> Column:
    """``#rrggbb`` to components between 0 and 1."""
    bare = F.regexp_replace(color, "^#", "")
    part = lambda at: F.conv(F.substring(bare, at, 2), 16, 10).cast("double") / D(255)
    return _rgb(part(1), part(3), part(5))


def rgb_to_hex(r, g, b) -> Column:
    part = lambda v: F.lower(F.lpad(F.hex(F.floor(v * D(255) + D(0.5)).cast("long")), 2, "0"))
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def color_array_to_hex(color, default) -> Column:
    return F.when(F.size(color) >= 3, rgb_to_hex(color[0], color[1], color[2])).otherwise(F.lit(default))


def parse_color(color) -> Column:
    """``#rrggbb``, ``rgb(...)`` or ``rgba(...)`` to components; anything else is black."""
    nums = F.regexp_extract_all(color, F.lit("([0-9.]+)"), F.lit(1))
    part = lambda i: F.get(nums, F.lit(i)).try_cast("double") / D(255)
    sound = (F.size(nums) >= 3) & part(0).isNotNull() & part(1).isNotNull() & part(2).isNotNull()
    return (
        F.when(color.startswith("#"), hex_to_rgb(color))
        .when(color.startswith("rgb") & sound, _rgb(part(0), part(1), part(2)))
        .otherwise(_rgb(D(0), D(0), D(0)))
    )


def html_to_text(html) -> Column:
    """Line breaks, then tags, then five entities, in this order."""
    out = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    # Fixed values.
    for entity, char in [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def format_bytes(n) -> Column:
    """``1.5 KB``: one decimal, dropped when it is zero."""
    label = None
    for i, unit in enumerate(BYTE_UNITS):
        value = F.regexp_replace(F.format_string("%.1f", n / D(1024 ** i)), r"\.0$", "")
        text = F.concat(value, F.lit(f" {unit}"))
        below = n < 1024 ** (i + 1)
        label = F.when(below, text) if label is None else (
            label.otherwise(text) if unit == BYTE_UNITS[-1] else label.when(below, text))
    return label


def relative_time(ts, now) -> Column:
    """``Just now``, ``5 minutes ago``, ... up to six days; the ISO date beyond."""
    seconds = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 1000000)
    mins, hours, days = F.floor(seconds / 60), F.floor(seconds / 3600), F.floor(seconds / 86400)

    def ago(n, unit):
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))

    return (
        F.when(mins < 1, "Just now").when(mins < 60, ago(mins, "minute")).when(hours < 24, ago(hours, "hour"))
        .when(days < 7, ago(days, "day")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def base_name(name) -> Column:
    """File name without its last extension; a leading dot does not count."""
    last = F.length(name) - F.length(F.substring_index(name, ".", -1))
    return F.when(last > 1, F.substring(name, F.lit(1), (last - 1).cast("int"))).otherwise(name)


def page_file_name(name, fmt, page_number, ext=None) -> Column:
    return F.concat(
        base_name(name), F.lit(f"_{fmt}_"), (page_number + 1).cast("string"), F.lit(f".{ext or fmt}"))


def decode_data_url(url) -> Column:
    """Media type and bytes of a base64 image URL; null type for anything but PNG and JPEG."""
    kind = F.regexp_extract(url, r"^data:image/(png|jpeg|jpg)", 1)
    payload = F.coalesce(F.nullif(F.get(F.split(url, ","), F.lit(1)), F.lit("")), url)
    media = F.when(kind == "png", "png").when(kind.isin("jpeg", "jpg"), "jpeg")
    return F.struct(media.alias("media"), F.when(media.isNotNull(), F.try_to_binary(payload, F.lit("base64"))).alias("data"))


def name_contains(name, query) -> Column:
    return F.contains(F.lower(name), F.lower(query))
