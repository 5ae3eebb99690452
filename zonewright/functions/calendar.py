"""Days of the normal year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_slot(date: Column) -> Column:
    """1 to 365; 29 February shares the slot of the 28th. Null for a null date."""
    leap = (F.month(date) == 2) & (F.dayofmonth(date) == 29)
    day = F.when(leap, F.lit(28)).otherwise(F.dayofmonth(date))
    return F.dayofyear(F.make_date(F.lit(2001), F.month(date), day))
