"""Bands for joins between rectangles and points on the same page.

Both sides are spread over horizontal bands of the page and joined on (document, page, band), so a dense page is
spread over many tasks and only neighbours meet.  A pair that shares several bands is kept in one of them: the
band in which the later of the two lower edges lies.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

BAND_HEIGHT = 64.0
# Band numbers saturate, which keeps a nonsensical rectangle from being spread over millions of bands.
LOWEST, HIGHEST = -64, 4096


def band_of(y: Column, height: float = BAND_HEIGHT) -> Column:
    clipped = F.least(F.greatest(F.floor(y / F.lit(height)), F.lit(LOWEST)), F.lit(HIGHEST))
    return clipped.cast("int")


def bands(y0: Column, y1: Column, height: float = BAND_HEIGHT) -> Column:
    """All bands touched by ``[y0, y1]``; an array to explode."""
    return F.sequence(band_of(y0, height), band_of(F.greatest(y0, y1), height))


def home_band(a_y0: Column, b_y0: Column, height: float = BAND_HEIGHT) -> Column:
    return band_of(F.greatest(a_y0, b_y0), height)
