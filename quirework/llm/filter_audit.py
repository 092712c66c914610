"""Filter interaction audit: what each filter removes in each order in which the filters may be applied.

1. Every document gets a mask, one bit per filter that it fails.  Documents with equal masks, part and labels are one
   cell with counts, so all that follows works on at most 2^filters cells a part and label.
2. A recursive query extends prefixes of filter orders by an unused letter.  It joins each of the possible masks and
   carries the bits applied so far; a level of the recursion holds the state of every mask at that step.
3. The cells join the walk by their mask: kept, removed and redundant documents of a step are sums over cells.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.plans.settle import settle

from .common import words

#: The recursion holds 2^n masks times all orders and their prefixes; with six filters that's 125,248 rows.
MOST_FILTERS = 6


def text_filters(text) -> dict[str, Column]:
    """Letter -> failure condition of the filters that see one text."""
    found, n = words(text), F.length(text)
    count = F.size(found)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": count < 200,
        "B": F.size(F.array_distinct(found)) * 100 < count * 50,
        "C": capitals.cast("long") * 100 > n.cast("long") * 2,
        "D": text.rlike("[#$%&*|]"),
    }


def cells_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of the documents; bits of the mask: A 1, B 2, C 4, D 8, E 16.

    E fails for a text that any row with a smaller doc_id has too.  Null texts are empty texts, a null doc_id is neither
    smaller nor larger than another, rows repeated under one doc_id are not copies of each other.  A document is good
    (toxic) when any row of ``labels`` says so, and neither without a row.  Further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(text_filters(text).values())), F.lit(0))
    flat = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
                       mask.alias("mask"))
    marks = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                                         F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    flat = flat.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    kind = ["digest", "mask", "part", "good", "toxic"]
    # Rows of one id first (they lie together after the join), then of a text: a large group of copies is a few rows
    # per task before it is shuffled by its text.
    per_id = flat.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    named = F.col("doc_id").isNotNull()
    per_text = settle(per_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("unnamed"),
        F.coalesce(F.min_by(F.when(named, F.col("n")), "doc_id"), F.lit(0)).alias("at_least")))
    first = per_text.groupBy("digest").agg(F.min("least").alias("first"))
    known = per_text.join(first, "digest")
    passing = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    split = F.explode(F.array(
        F.struct(F.col("mask").alias("m"), passing.alias("k")),
        F.struct((F.col("mask") + 16).alias("m"), (F.col("n") - passing).alias("k"))))
    spread = known.select("part", "good", "toxic", split.alias("s")).filter("s.k > 0")
    return spread.groupBy("part", F.col("s.m").alias("mask")).agg(
        F.sum("s.k").alias("n"), F.sum(F.col("s.k") * F.col("good")).alias("good"),
        F.sum(F.col("s.k") * F.col("toxic")).alias("toxic"))


def walk(spark, letters: str) -> DataFrame:
    """(prefix, step, letter, bit, earlier, applied, mask): every prefix of every order, for every mask."""
    if not 0 < len(letters) <= MOST_FILTERS:
        raise ValueError(f"between one and {MOST_FILTERS} filters")
    filters = ", ".join(f"('{x}', {1 << k})" for k, x in enumerate(letters))
    return spark.sql(f"""
        with recursive filters(letter, bit) as (values {filters}),
        walk(prefix, step, letter, bit, earlier, applied, mask) as (
            select '', 0, '', 0, 0, 0, id from (select explode(sequence(0, {(1 << len(letters)) - 1})) as id)
            union all
            select concat(w.prefix, f.letter), w.step + 1, f.letter, f.bit, w.applied, w.applied | f.bit, w.mask
            from walk w join filters f on (w.applied & f.bit) = 0)
        select * from walk where step > 0""")


def audit(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, filter_order and step, zeros included: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, and shapley, the sum of the filter's removed over all orders.  No cells: no rows."""
    spark, count = cells.sparkSession, len(letters)
    cells = settle(cells)
    bit, earlier, applied, mask = (F.col(c) for c in ("bit", "earlier", "applied", "mask"))
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(earlier) != 0
    taken = fails & ~gone

    def total(name, when):
        return F.sum(F.when(when, F.col(name)).otherwise(0)).cast("long")

    steps = settle(walk(spark, letters).join(cells, "mask").groupBy("part", "prefix", "step", "letter").agg(
        total("n", mask.bitwiseAND(applied) == 0).alias("kept"), total("n", taken).alias("removed"),
        total("n", fails & gone).alias("redundant"), total("n", mask == bit).alias("unique_fails"),
        total("good", taken).alias("good_lost"), total("toxic", taken).alias("toxic_lost")))
    # A prefix begins (count - step)! orders.
    orders = F.element_at(F.array(*[F.lit(math.factorial(count - k)) for k in range(1, count + 1)]), F.col("step"))
    share = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders).cast("long").alias("shapley"))
    whole = steps.filter(F.col("step") == count).select(
        "part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(count))).alias("step"))
    at = whole.withColumn("prefix", F.substring(F.col("filter_order"), F.lit(1), F.col("step")))
    return at.join(steps, ["part", "prefix", "step"]).join(share, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
