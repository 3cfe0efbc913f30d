"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more rows than this, and more than a thousandth of all, have their rows dealt to SALTS tasks.
HOT, SALTS = 100_000, 64


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], by: str, size: str, hot: int = HOT) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key; ``size``: how many ``rows`` have the key), inner join.

    Rows of a key with more than ``hot`` of them are spread over salts by a hash of the column ``by``, and the table's row
    is repeated for each salt. The hot keys are known by a broadcast table; with a ``hot`` of at least a thousandth of
    all rows it has at most 1,000 of them.
    """
    crowded = F.col(size) > hot
    marked = rows.join(F.broadcast(table.filter(crowded).select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    marked = marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    copies = F.when(crowded, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return marked.join(table.withColumn("_salt", F.explode(copies)), [*keys, "_salt"]).drop("_salt")
