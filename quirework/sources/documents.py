"""Files to documents, and the hook for a parser of their bytes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import normalize_rotation

# Fixed values.
PDF_TYPE = "application/pdf"
PDF_GLOB = "*.[pP][dD][fF]"


def scan_documents(spark: SparkSession, path: str, with_content=False, glob=PDF_GLOB) -> DataFrame:
    """One row per document file below ``path``; the bytes are read only when asked for."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    )
    cols = [
        F.xxhash64("path").alias("doc_id"), F.substring_index("path", "/", -1).alias("name"),
        F.col("length").alias("file_size"), F.col("modificationTime").alias("last_modified"), "path",
    ]
    return found.select(*cols, *(["content"] if with_content else []))


def accepts(name, media_type):
    """Whether an offered file is a PDF, by media type or suffix."""
    return F.coalesce(media_type == PDF_TYPE, F.lit(False)) | F.lower(name).endswith(".pdf")


def parse_pdf(documents: DataFrame, fn, schema: str) -> DataFrame:
    """Run a user's parser over document bytes: ``fn`` maps an iterator of pandas frames to another."""
    return documents.mapInPandas(fn, schema)


def page_metadata(bounds: DataFrame) -> DataFrame:
    """Page sizes from ``bounds`` ``[x0, y0, x1, y1]``; rotation brought into 0..359."""
    b = F.col("bounds")
    return bounds.select(
        "doc_id", F.col("page_number").cast("int").alias("page_number"), (b[2] - b[0]).alias("width"),
        (b[3] - b[1]).alias("height"), normalize_rotation(F.coalesce("rotation", F.lit(0))).alias("rotation"))
