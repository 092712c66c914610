"""Document tables derived from the driver's parquet tables (see FIXTURES.md)."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .deal import deal

CHAR_WIDTH, LINE_PITCH, LINES_PER_PAGE, MARGIN = 7.2, 16.0, 20, 72.0
# How ``lines`` and ``spans`` are dealt.
DEALT_BY = ["doc_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def page_width(doc_id: Column) -> Column:
    k = doc_id % 4
    return F.when(k == 2, F.lit(595.0)).when(k == 3, F.lit(792.0)).otherwise(F.lit(612.0))


def page_height(doc_id: Column) -> Column:
    k = doc_id % 4
    return (
        F.when(k == 0, F.lit(792.0)).when(k == 1, F.lit(1008.0)).when(k == 2, F.lit(842.0)).otherwise(F.lit(1224.0))
    )


def lines(spark, sf_dir) -> DataFrame:
    # Shuffle the documents while they are still one compact row each: everything below is keyed by document and
    # page, so the words need no shuffle of their own.
    docs = deal(table(spark, sf_dir, "documents").select("doc_id", "text"), DEALT_BY)
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def spans(spark, sf_dir) -> DataFrame:
    """Words of ``documents.text`` with positions, in PDF space."""
    before = Window.partitionBy("doc_id", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    exploded = (
        lines(spark, sf_dir)
        .filter(F.col("line") != "")
        .select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("word_no", "text"))
        .withColumn("off", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
        .filter(F.col("text") != "")
    )
    x = F.lit(MARGIN) + F.col("off") * F.lit(CHAR_WIDTH)
    y = F.lit(MARGIN) + (F.col("line_no") % LINES_PER_PAGE) * F.lit(LINE_PITCH) + (F.col("word_no") % 3) * F.lit(1.0)
    h = page_height(F.col("doc_id"))
    return exploded.select(
        "doc_id",
        F.floor(F.col("line_no") / LINES_PER_PAGE).cast("int").alias("page_number"),
        (F.col("line_no").cast("long") * 100000 + F.col("word_no")).alias("span_id"),
        "text",
        x.alias("x0"),
        (h - (y + F.lit(12.0))).alias("y0"),
        (x + F.length("text") * F.lit(CHAR_WIDTH)).alias("x1"),
        (h - y).alias("y1"),
        F.lit(12.0).alias("font_size"),
    )


def pages(spark, sf_dir) -> DataFrame:
    # Lines are counted inside their document's row, so that only page numbers are shuffled, by document as in ``lines``.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    on_page = F.transform(F.split("text", "\n"), lambda line, i: F.when(
        F.trim(line) != "", F.floor(i / LINES_PER_PAGE).cast("int")))
    numbered = table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.array_compact(F.array_distinct(on_page))).alias("page_number"))
    doc = F.col("doc_id")
    return (
        numbered.repartition(max(n, spark.sparkContext.defaultParallelism), "doc_id")
        .distinct()
        .select(
            "doc_id",
            "page_number",
            page_width(doc).alias("width"),
            page_height(doc).alias("height"),
            ((doc % 4) * 90).cast("int").alias("rotation"),
        )
    )


def docs(spark, sf_dir) -> DataFrame:
    counted = pages(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("doc."), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"),
        F.col("n_chars").alias("file_size"),
    ).join(counted, "doc_id")


def annotations(spark, sf_dir) -> DataFrame:
    """One annotation per event; some point past the last page of their document."""
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
    e = F.col("event_id")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        e.alias("ann_id"),
        (F.col("user_id") % n).alias("doc_id"),
        (e % 3).cast("int").alias("page_number"),
        e.alias("ord"),
        F.when(kind == "click", "highlight").when(kind == "view", "text").when(kind == "error", "redact")
        .when(kind == "purchase", "stamp").otherwise("formField").alias("type"),
        (40 + (e * 37) % 400).cast("double").alias("x"),
        ((e * 53) % 700).cast("double").alias("y"),
        (20 + (e % 7) * 15).cast("double").alias("width"),
        (12 + (e % 3) * 10).cast("double").alias("height"),
        F.concat(F.lit("note "), (e % 10).cast("string")).alias("content"),
        F.col("value").alias("value"),
    )


def valid_annotations(spark, sf_dir) -> DataFrame:
    """Annotations folded onto the pages that exist."""
    counted = pages(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
    a = annotations(spark, sf_dir)
    return a.join(counted, "doc_id").select(
        *[(F.col("page_number") % F.col("page_count")).alias("page_number") if c == "page_number" else F.col(c)
          for c in a.columns]
    )


def edit_events(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts",
        (F.col("user_id") % 20).alias("doc_id"),
        (F.col("event_id") % 40).alias("ann_id"),
        F.when(kind == "signup", "add").when(kind == "click", "update").when(kind == "purchase", "remove")
        .when(kind == "error", "undo").otherwise("redo").alias("op"),
        "value",
    )


def open_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("event_type") == "view").select(
        "event_id", "ts", "user_id",
        F.concat(F.lit("/d/"), (F.col("user_id") % 50).cast("string"), F.lit(".pdf")).alias("path"),
        F.concat((F.col("user_id") % 50).cast("string"), F.lit(".pdf")).alias("name"),
    )


def outline_nodes(spark, sf_dir) -> DataFrame:
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        turn.alias("node_id"),
        F.when(turn > 0, F.floor((turn - 1) / 2)).alias("parent_id"),
        turn.cast("int").alias("ord"),
        F.concat("role", F.lit(" "), turn.cast("string")).alias("title"),
        turn.cast("int").alias("page_number"),
    )
