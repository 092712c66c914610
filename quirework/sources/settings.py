"""Persisted settings JSON ``{"settings": {docId: {...}}}``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names in the file, and the columns of the table that hold them.
PLAIN = {"orientation": "orientation", "pageSize": "page_size", "pagesPerSheet": "pages_per_sheet", "pageOrder": "page_order",
         "marginPreset": "margin_preset", "scalingMode": "scaling_mode", "customScale": "custom_scale", "printRange": "print_range",
         "customRange": "custom_range"}
NESTED = {"customPageSize": {"width": "custom_width", "height": "custom_height"},
          "customMargins": {"top": "margin_top", "right": "margin_right", "bottom": "margin_bottom", "left": "margin_left"}}
KINDS = {"pages_per_sheet": "INT", "custom_scale": "DOUBLE", **{c: "DOUBLE" for cs in NESTED.values() for c in cs.values()}}
COLUMNS = [*PLAIN.values(), *[c for cs in NESTED.values() for c in cs.values()]]

_FIELDS = [f"{j}: {KINDS.get(c, 'STRING')}" for j, c in PLAIN.items()] + [
    f"{j}: STRUCT<{', '.join(f'{k}: DOUBLE' for k in cs)}>" for j, cs in NESTED.items()]
SETTING = f"STRUCT<{', '.join(_FIELDS)}>"


def read_settings(df: DataFrame, json_col="json") -> DataFrame:
    """``doc_id`` and the columns of ``COLUMNS``; ids are the text that the file has, whatever it looks like."""
    parsed = F.from_json(json_col, f"settings MAP<STRING, {SETTING}>")["settings"]
    return df.select(F.explode(parsed).alias("doc_id", "_v")).select(
        "doc_id", *[F.col(f"_v.{j}").alias(c) for j, c in PLAIN.items()],
        *[F.col(f"_v.{j}.{k}").alias(c) for j, cs in NESTED.items() for k, c in cs.items()])


def write_settings(settings: DataFrame, per_file=1000) -> DataFrame:
    """JSON values of about ``per_file`` documents each, dealt by a hash of the id, so that none grows with the corpus; each reads
    back on its own.  Rows without an id have no place in the file; columns that are missing or null are left out."""
    have = settings.filter(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("string"))

    def col(c):
        return (F.col(c) if c in settings.columns else F.lit(None)).cast(KINDS.get(c, "STRING"))

    plain = [col(c).alias(j) for j, c in PLAIN.items()]
    nested = [F.when(F.coalesce(*[col(c) for c in cs.values()]).isNotNull(), F.struct(*[col(c).alias(k) for k, c in cs.items()])).alias(j)
              for j, cs in NESTED.items()]
    row = F.struct(F.col("doc_id").alias("key"), F.struct(*plain, *nested).alias("value"))
    parts = -(-max(have.count(), 1) // per_file)
    return have.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part")).agg(
        F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(row))).alias("settings"))).alias("json"))
