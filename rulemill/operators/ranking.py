"""First n rows per key without gathering a key in one task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this size Spark itself cuts each group before the shuffle (its group-limit rule).
GROUP_LIMIT = 1000
SALTS = 256


def first_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salt_from: Sequence[str],
    rank: str = "row_rank",
) -> DataFrame:
    """Rows ranked 1..n within each key by a total order.

    For small n the partial group limit keeps at most n rows per key and task before the
    shuffle. For larger n the rows of a key are first cut within salted slices.
    """
    if n > GROUP_LIMIT:
        slices = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*salt_from), F.lit(SALTS)))
            .withColumn("_slice_rank", F.row_number().over(slices))
            .where(F.col("_slice_rank") <= n)
            .drop("_salt", "_slice_rank")
        )
    within = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(within)).where(F.col(rank) <= n)
