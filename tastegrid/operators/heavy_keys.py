"""Per-key results without stragglers where few keys hold most records.

Only algebraic aggregates are used, so each mapping task combines its rows in a bounded hash table (Spark spills
it) and ships one compact state per key. Distinct partners are counted in two steps: the first groups by
(key, partner), which spreads a hot key over all partitions; the second combines the per-key states map-side.
Both key fields are read off the same grouping of (item, user), whose exchange is computed once.

Defined results: null keys have no row (their records still count in totals); a null partner is not a distinct
partner; null and NaN ratings are outside the mean; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastegrid.plans.scratch import cut


def per_key(records: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """(key_field, key_value, n_rows, n_partners, mean_value) for both key columns, each the other's partner."""
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    pairs = records.groupBy(F.col(first).cast("string").alias("p"), F.col(second).cast("string").alias("q")).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.count(v).alias("c"))

    def one(key: str, partner: str, name: str) -> DataFrame:
        done = pairs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key_value")).agg(F.sum("n").alias("n_rows"), F.count(partner).alias("n_partners"), (F.sum("s") / F.sum("c")).alias("mean_value"))
        return done.select(F.lit(name).alias("key_field"), "key_value", "n_rows", "n_partners", "mean_value")

    return one("p", "q", first).unionByName(one("q", "p", second))


def heavy(records: DataFrame, columns: tuple[str, ...], per_cent: int) -> DataFrame:
    """(key_field, key_value, n_rows) of the non-null keys that hold at least ``per_cent`` % of all rows.

    One scan feeds the counts of all columns; the total includes rows with null keys.
    """
    entries = F.array(*(F.struct(F.lit(c).alias("key_field"), F.col(c).cast("string").alias("key_value")) for c in columns))
    counts = records.select(F.explode(entries).alias("e")).groupBy("e.key_field", "e.key_value").agg(F.count("*").alias("n_rows"))
    counts = cut(counts)
    total = counts.where(F.col("key_field") == columns[0]).agg(F.sum("n_rows")).first()[0] or 0
    return counts.where(F.col("key_value").isNotNull() & (F.col("n_rows") * 100 >= F.lit(per_cent * total)))
