"""Bounded samples for fitting: by a hash of the id, so that no sort and no second shuffle is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = 1 << 30


def chosen(key: Column, wanted: Column | int, total: Column | int, salt: int) -> Column:
    """True for about `wanted` of `total` rows, always the same ones; for all if there are fewer."""
    share = F.greatest(F.lit(1), F.lit(total) if isinstance(total, int) else total)
    limit = (F.lit(wanted) if isinstance(wanted, int) else wanted).cast("double") / share.cast("double") * _SPACE
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(_SPACE)) < limit
