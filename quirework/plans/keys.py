"""Keys on their way through Python: pandas turns a column with nulls into floats, which changes large ids."""

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_KEY = "-"


def key_text(col) -> Column:
    """A key as text that is never null and tells null apart from every value."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(NO_KEY))


def key_back(col, kind) -> Column:
    """The key behind its text, as a value of type ``kind``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != NO_KEY, F.substring(c, 2, 1 << 30)).cast(kind)
