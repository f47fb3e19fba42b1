"""Join keys that do not pile up in one task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spread_blank(key: Column, row_id: Column) -> Column:
    """A left join key in which rows without a key get one of their own.

    NULL and empty keys match nothing, but as one value they would all be shuffled to one task. Ids never hold a
    NUL character, so the made-up keys match nothing either.
    """
    return F.when(key.isNull() | (key == ""), F.concat(F.lit("\0"), row_id.cast("string"))).otherwise(key)
