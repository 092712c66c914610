"""SimHash fingerprints of texts and the search for near fingerprints, with DataFrame functions only.

Terms are pairs of adjacent words (a text of one word has that word).  A term's 64-bit hash votes on 64 signed bits
with a weight that grows with the words' length, so that pairs of short, common words count less.
"""

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.plans.settle import settle

from .common import numbered, words

BITS = 64
#: A term's weight is the number of characters of its words, at most this.
HEAVIEST = 24
_LOW = (1 << 32) | 1


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bits) of ``texts`` (keys, text): the 64-bit fingerprint of each key; 0 for texts without words.

    Two votes share a 64-bit counter (bit i and bit i + 32), so 32 sums carry all votes; a text's terms are summed
    where they are read, and one row per text and task is shuffled.  A text's weights must sum to less than 2**32.
    """
    w = words(F.col("text"))
    many = texts.select(*keys, w.alias("w"))
    pairs = F.arrays_zip("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("v"))
    each = many.select(*keys, F.explode_outer(pairs).alias("t"), (F.size("w") == 1).alias("one"))
    left, right = F.col("t.w"), F.col("t.v")
    kept = right.isNotNull() | F.col("one")
    size = F.least(F.length(left) + F.coalesce(F.length(right), F.lit(0)), F.lit(HEAVIEST)).cast("long")
    each = each.select(*keys, F.when(kept, F.xxhash64(left, F.coalesce(right, F.lit("")))).alias("h"),
                       F.when(kept, size).otherwise(F.lit(0)).cast("long").alias("n"))
    votes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_LOW)) * F.col("n")).alias(f"v{i}") for i in range(32)]
    summed = each.groupBy(*keys).agg(F.sum("n").alias("n"), *votes)
    bits = F.lit(0).cast("long")
    for i in range(32):
        votes_ = F.coalesce(F.col(f"v{i}"), F.lit(0))
        low, high = votes_.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(votes_, 32)
        bits = bits.bitwiseOR(F.when(2 * low > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0)))
        bits = bits.bitwiseOR(F.when(2 * high > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i + 32)).otherwise(F.lit(0)))
    return summed.select(*keys, bits.alias("bits"))


def as_text(bits) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def likeness(a, b) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(float(BITS))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and their likeness: (doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last quarter of code points (rounded down) replaced by as many of the first of the next
    document, or all of it; documents stand in ascending order of id, nulls first, rows of one id by a hash of the
    text; the last is followed by the first.  Null text: empty.  Rows with equal id and text are one document, repeated in
    the result.  A single document is its own next.  An empty table gives no rows; other columns are ignored.

    Only ids and lengths are sorted.  Texts are shuffled once; a document sends its neighbour no more than the
    characters it needs.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    base = base.select("doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("k1"),
                       F.xxhash64("text", F.col("doc_id").isNull()).alias("k2"))
    narrow = base.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).alias("n"))
    placed = settle(numbered(narrow, [F.col("doc_id").asc_nulls_first(), F.col("k2")]))
    total = F.lit(placed.count())
    before = placed.select(F.pmod(F.col("idx") + 1, total).alias("idx"), F.floor(F.col("n") / 4).alias("asked"),
                           F.col("k1").alias("to1"), F.col("k2").alias("to2"))
    plan = settle(placed.join(before, "idx"))
    one = base.select("k1", "k2", "text").join(plan, ["k1", "k2"])  # the same columns in both uses: one shuffle of the texts
    # Rows that repeat id and text all stay here: they multiply votes and weights alike.
    sent = one.select(F.col("to1").alias("k1"), F.col("to2").alias("k2"), F.substring("text", 1, F.col("asked")).alias("tail"))
    sent = sent.dropDuplicates(["k1", "k2"])
    head = F.substring("text", 1, F.col("n") - F.floor(F.col("n") / 4))
    met = one.join(sent, ["k1", "k2"]).withColumn("edited", F.concat(head, "tail"))
    both = met.select("idx", "doc_id", "copies", F.col("n").cast("long").alias("n_chars"),
                      F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")),
                                        F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x"))
    marked = both.select("idx", "doc_id", "copies", "n_chars", F.col("x.kind").alias("kind"), F.col("x.text").alias("text"),
                         F.when(F.col("x.kind") == 1, F.sha2(F.encode("x.text", "UTF-8"), 256)).alias("sha"))
    prints = settle(fingerprints(marked, ["idx", "doc_id", "copies", "n_chars", "kind", "sha"]))
    plain = prints.filter("kind = 0").select("idx", "doc_id", "copies", "n_chars", F.col("bits").alias("own_bits"))
    edited = prints.filter("kind = 1").select("idx", F.col("sha").alias("edited_sha256"), F.col("bits").alias("edited_bits"))
    nexts = plain.select(F.pmod(F.col("idx") - 1 + total, total).alias("idx"), F.col("own_bits").alias("next_bits"))
    out = plain.join(edited, "idx").join(nexts, "idx")
    out = out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own_bits")).alias("fingerprint"),
                     as_text(F.col("edited_bits")).alias("edited_fingerprint"),
                     likeness("own_bits", "edited_bits").alias("near_edited"),
                     likeness("own_bits", "next_bits").alias("near_next"), "copies")
    return out.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_c", "copies")


def near(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b) of all distinct fingerprints ``bits`` within ``radius`` bits of each other, a < b.

    Permuted block tables: the 64 bits are cut into ``blocks`` blocks; two fingerprints within the radius agree in at
    least ``blocks - radius`` of them, so there is a table for each choice of that many blocks, joined on those bits
    (32 of 64 for 3 of 6).  Equal fingerprints are one row; a pair is kept from its first table only.
    """
    assert 0 <= radius < blocks
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in pick) for pick in combinations(range(blocks), blocks - radius)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    listed = F.array(*[F.lit(m).cast("long") for m in masks])
    keyed = prints.select("bits").filter(F.col("bits").isNotNull()).distinct().select("bits", F.posexplode(listed).alias("t", "mask"))
    keyed = keyed.select("t", F.col("bits").bitwiseAND(F.col("mask")).alias("key"), "bits")
    left, right = keyed.withColumnRenamed("bits", "a"), keyed.withColumnRenamed("bits", "b")
    met = left.join(right, ["t", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    earlier = F.exists(F.slice(listed, 1, F.col("t")), lambda m: F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(m) == 0)
    return met.filter(~earlier).select("a", "b")
