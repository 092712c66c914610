"""Tables dealt alike by their leading keys meet without a further shuffle."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def deal(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows with equal ``by`` in one partition, always of the same number of partitions.

    Tables dealt by the same columns are grouped, numbered and put together (``noted``) by keys that hold these columns where their
    rows are.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *by)


def noted(rows: DataFrame, notes: DataFrame, keys: list[str], name: str, gathered) -> DataFrame:
    """``rows`` with a column ``name``: what ``gathered`` (an aggregate) makes of the notes of their keys, each a struct of its other columns.

    Rows and notes are put together and gone through key by key.  Where both are dealt by some of the keys nothing is shuffled,
    which a join on more keys than these would do with both sides.  Null keys meet nothing, as in a join.
    """
    note = F.struct(*[c for c in notes.columns if c not in keys]).alias("_note")
    known = notes.filter(reduce(and_, [F.col(k).isNotNull() for k in keys])).select(*keys, note)
    both = rows.unionByName(known, allowMissingColumns=True)
    return both.withColumn(name, gathered(F.col("_note")).over(Window.partitionBy(*keys))).filter(F.col("_note").isNull()).drop("_note")
