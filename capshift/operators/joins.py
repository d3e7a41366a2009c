"""Join helpers with an explicit size check before broadcasting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A per-policy or per-capacity table above this many rows is no longer broadcast as a whole.
MAX_BROADCAST_ROWS = 200_000
# Beyond that, keys that hold this share of the big side (so a thousand at most) still are.
HOT_SHARE = 1 / 1000


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left",
               max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` with a side that is small in practice, checked before use (``left`` or ``inner``).

    Used where the join key has few distinct values (a policy id), so that a
    shuffled join would send all rows of one key to one task. ``small`` should
    be materialized (checkpointed) so that counting it is cheap, and unique by its key.
    A side that has grown large is joined by shuffle, except for its hot keys: their few
    rows are broadcast, and the big side's rows of these keys stay where they are.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    keys = [on] if isinstance(on, str) else list(on)
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counts.where(F.col("_rows") >= F.lit(max(1, int(big.count() * HOT_SHARE)))).select(*keys)
    hot = F.broadcast(small.join(F.broadcast(hot), keys, "left_semi"))
    cold = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small, keys, how)
    return big.join(hot, keys, "inner").unionByName(cold)
