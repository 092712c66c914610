"""Mixing sources to target weights: whole epochs first, then a weighted sample without replacement to the budget."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.plans.settle import settle

from .common import numbered, running

#: Weights of the sources in code-point order, repeating (fixed values of the task).
WEIGHTS = (1, 2, 3)


def n_words(text) -> Column:
    """Number of words of a text (null: 0), counted by their ends."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text) -> Column:
    """A document's weight in the sample: 0.1 plus 0.9 times the share of characters that are no digit, symbol or
    upper-case ASCII letter; 1.0 for a null or empty text.  Built from two lengths, so it is exact and cheap."""
    odd = F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&*|<>{}[]=_", ""))
    whole = F.length(text)
    return F.when(whole > 0, F.lit(0.1) + F.lit(0.9) * odd / whole).otherwise(F.lit(1.0))


def targets(sources: DataFrame, most: int = 3, weights: tuple = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    The weights share the sum of all sizes; a source stops at ``most`` times its size and the excess is shared again
    among the others until none is above.  Each round is one sum over the sources; the sources stay distributed.
    """
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    now = settle(ranked.select("source", "source_size", weight.cast("long").alias("weight"),
                               (most * F.col("source_size")).alias("cap")))
    total, weight_sum = now.agg(F.sum("source_size"), F.sum("weight")).first()
    pool, share, held = total or 0, weight_sum or 1, 0
    wide = T.DecimalType(38, 0)
    while True:
        # The level pool / share only rises, so a source that has stopped stays so.  Whole numbers: cap < weight * level.
        stopped = F.col("cap").cast(wide) * F.lit(share) < F.col("weight").cast(T.DecimalType(18, 0)) * F.lit(pool)
        n, cap, weight = now.filter(stopped).agg(F.count(F.lit(1)), F.sum("cap"), F.sum("weight")).first()
        if n == held:
            break
        held, pool, share = n, total - cap, weight_sum - weight
    fair = F.col("weight").cast("double") * F.lit(float(pool)) / F.lit(float(share))
    return now.select("source", "source_size", F.when(stopped, F.col("cap").cast("double")).otherwise(fair).alias("target"))


def mix(docs: DataFrame, most: int = 3, weights: tuple = WEIGHTS, seed: str = "mix") -> DataFrame:
    """(doc_id, source, _text, size, source_size, target, epochs, part, taken) for each document.

    ``epochs`` whole copies of every document of a source come first; the rest of the budget is filled by
    Efraimidis-Spirakis sampling: the key of a document is an exponential variable over its quality weight, documents
    are sorted by key within the source and taken while the prefix sum is within the budget; the one that crosses it
    gives its first words (``part``: words taken beyond the epochs).  Uniform numbers come from md5 of id, seed and
    length, so reruns agree.  A source's rows are spread over ranges of the order, whatever its share.

    Null text has size 0 and takes 0.  Documents of null source form a source.  Documents with equal ids or null ids
    each count; equal keys fall back to the id.  An empty table gives no rows; other columns are ignored.
    """
    name = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.length("text").cast("string"))
    unit = (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    sized = settle(docs.select("doc_id", "source", F.xxhash64("text").alias("_text"), n_words(F.col("text")).alias("size"),
                               (-F.log(unit) / quality_weight(F.col("text"))).alias("key")))
    per = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most, weights)
    ordered = running(sized, "source", [F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("_text")], "size")
    per = per.withColumnRenamed("source", "_source")
    joined = ordered.join(per, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("before")
    part = F.least(F.greatest(left, F.lit(0)), F.col("size")).cast("long")
    out = joined.withColumn("epochs", epochs).withColumn("part", part)
    return out.select("doc_id", "source", "_text", "size", "source_size", "target", "epochs", "part",
                      (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mixed(docs: DataFrame, most: int = 3, weights: tuple = WEIGHTS, seed: str = "mix") -> DataFrame:
    """The mix itself: ``docs`` with every document as often as it has epochs, and the last, partial copy cut after
    its ``part`` words.  Documents are found again by id and text, so equal rows are given once for each row."""
    plan = mix(docs, most, weights, seed)
    keys = ["doc_id", "source", "_text"]
    rest = docs.withColumn("_text", F.xxhash64("text")).dropDuplicates(keys)
    whole = (F.col("part") == F.col("size")) & (F.col("size") > 0)
    takes = plan.groupBy(*keys).agg(F.sum(F.col("epochs") + whole.cast("long")).alias("_copies"),
                                    F.coalesce(F.max(F.when(~whole, F.col("part"))), F.lit(0)).alias("_part"))
    takes = takes.select(*[F.col(k).alias(f"_{k}") for k in keys], "_copies", "_part")
    met = rest.join(takes, F.col("doc_id").eqNullSafe(F.col("_doc_id"))
                    & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_text") == F.col("__text")))
    numbers = F.sequence(F.lit(1).cast("long"), F.col("_copies") + (F.col("_part") > 0).cast("long"))
    met = met.filter((F.col("_copies") > 0) | (F.col("_part") > 0)).withColumn("_copy", F.explode(numbers))
    pieces = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.col("text").rlike(r"^[\x20\x09-\x0D]").cast("int")
    first = F.array_join(F.slice(pieces, F.lit(1), F.col("_part").cast("int") + lead), "")
    text = F.when(F.col("_copy") > F.col("_copies"), first).otherwise(F.col("text"))
    return met.withColumn("text", text).select(*docs.columns)
