"""Exports: text, HTML, one folder per page."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import base_name
from ..operators.text import PAGES_PER_PART, joined_text, page_banner, page_or_placeholder


def text_records(page_texts: DataFrame) -> DataFrame:
    """One record per page; written one per line in page order they form the text of the document."""
    page = F.col("page_number")
    return page_texts.select(
        "doc_id", "page_number", page_banner(page, page_or_placeholder(page, F.col("text"))).alias("value"))


def export_text(page_texts: DataFrame, path: str) -> None:
    """Write the text of every document to ``path/doc_id=.../``.

    Range partitioning keeps the pages of a document in order over its files without gathering them: the files of
    a folder, read in name order, are the text.
    """
    (text_records(page_texts).repartitionByRange("doc_id", "page_number").sortWithinPartitions("doc_id", "page_number")
     .select("doc_id", "value").write.partitionBy("doc_id").mode("errorifexists").text(path))


def html_page(page_number, fragment):
    """Wrapper of a page's fragment; a page without one becomes an error note."""
    n = (page_number + 1).cast("string")
    return F.when(fragment.isNotNull(), F.concat(
        F.lit('<div class="page" data-page="'), n, F.lit('">'), fragment, F.lit("</div>"))).otherwise(
        F.concat(F.lit('<div class="page error">Error converting page '), n, F.lit("</div>")))


def html_head(name):
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<title>'), base_name(name),
        F.lit("</title>\n</head>\n<body>\n"))


HTML_TAIL = "\n</body>\n</html>"


def export_html(fragments: DataFrame, docs: DataFrame, pages_per_part=PAGES_PER_PART) -> DataFrame:
    """HTML of documents in parts of ``pages_per_part`` pages; the parts in order, joined by a newline, are the page.

    The first part opens the document and the last closes it.
    """
    page = F.col("page_number")
    parts = fragments.withColumn("part", F.floor(page / pages_per_part).cast("int")).groupBy("doc_id", "part").agg(
        joined_text(page, html_page(page, F.col("fragment")), "\n").alias("_body"))
    ends = parts.groupBy("doc_id").agg(F.min("part").alias("_first"), F.max("part").alias("_last"))
    head = F.when(F.col("part") == F.col("_first"), html_head(F.col("name"))).otherwise("")
    tail = F.when(F.col("part") == F.col("_last"), HTML_TAIL).otherwise("")
    return parts.join(ends, "doc_id").join(docs.select("doc_id", "name"), "doc_id").select(
        "doc_id", "part", F.concat(head, "_body", tail).alias("html"))


def write_pages(df: DataFrame, path: str, buckets=256, fmt="parquet") -> None:
    """Write rows of pages as folders, in place of an archive of page files.

    Documents are hashed into ``buckets`` folders and sorted by document and page inside, so that a reader of one
    page opens one folder and skips by file statistics; the number of files does not grow with the number of pages.
    ``buckets=None`` makes a folder per document and page, for small exports.
    """
    keys = ["doc_id", "page_number"]
    if buckets is None:
        parts, shaped = keys, df.repartitionByRange(*keys)
    else:
        parts = ["doc_bucket"]
        shaped = df.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
        # Range partitioning also cuts a bucket that one document fills.
        shaped = shaped.repartitionByRange("doc_bucket", *keys).sortWithinPartitions("doc_bucket", *keys)
    shaped.write.partitionBy(*parts).mode("errorifexists").format(fmt).save(path)
