"""How distinctive a term is of its record: divergence from randomness (geometric model, Laplace gain).

Texts move once, to the partition of their item; there repeated deliveries are dropped and terms are counted, all by expressions
inside the JVM that keep that partitioning, so only (item, term) counts leave it. An item with more text than PIECE_BYTES is split by review over
several partitions, through a broadcast list of at most MAX_SPLIT items; only its partial counts are merged afterwards.

With F occurrences of a term in the collection, N items, tf in the item, dl the item's length in terms and
avgdl the mean length: tfn = tf * log2(1 + c * avgdl / dl), information = log2(1 + F/N) + tfn * log2(1 + N/F),
Laplace gain = 1 / (1 + tfn), weight = information * gain. ``idf_weight`` = (1 + ln tf) * ln(1 + N / (1 + df)).

Defined results: rows with a null group or text count for nothing; texts without terms make no item;
repeated record ids count once, null ids each for themselves; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tastegrid.plans.scratch import cut, parallelism

TERM = "[a-z][a-z0-9_-]{2,}"
#: Characters of text that one partition takes, and beyond which an item is split.
PART_BYTES, PIECE_BYTES = 8 << 20, 4 << 20
#: Items that are split at most; with more text than MAX_SPLIT pieces hold, pieces are larger.
MAX_SPLIT = 100_000


def term_counts(records: DataFrame, id_col: str, group_col: str, text_col: str) -> DataFrame:
    """(item, term, tf, reviews): occurrences of each term per item and the number of its records that hold it; stored, for repeated use."""
    spark = records.sparkSession
    rows = records.select(F.col(group_col).cast("string").alias("item"), F.col(id_col).cast("string").alias("rid"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    sizes = cut(rows.groupBy("item").agg(F.sum(F.length("text") + 1).alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    piece = max(PIECE_BYTES, total // MAX_SPLIT)
    parts = max(parallelism(spark), min(-(-total // PART_BYTES), MAX_SPLIT))
    # fewer than total / piece <= MAX_SPLIT items
    split = F.broadcast(sizes.where(F.col("n") > piece).select("item", F.ceil(F.col("n") / piece).cast("int").alias("pieces")))
    own = F.coalesce("rid", F.concat(F.lit(" "), F.monotonically_increasing_id().cast("string")))
    keyed = rows.withColumn("rid", own).join(split, "item", "left").withColumn("piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("rid"), F.col("pieces")).cast("int")).otherwise(-1)).drop("pieces")
    once = keyed.repartition(parts, "item", "piece").groupBy("item", "piece", "rid").agg(F.first("text").alias("text"))
    terms = once.select("item", "piece", "rid", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term"))
    per_record = terms.groupBy("item", "piece", "term", "rid").agg(F.count("*").alias("tf"))
    counted = cut(per_record.groupBy("item", "piece", "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("reviews")))
    merged = counted.where("piece >= 0").groupBy("item", "term").agg(F.sum("tf").alias("tf"), F.sum("reviews").alias("reviews"))
    return counted.where("piece < 0").select("item", "term", "tf", "reviews").unionByName(merged)


def term_weights(records: DataFrame, id_col: str, group_col: str, text_col: str, *, min_reviews: int = 1, max_share: tuple[int, int] = (1, 1), c: float = 1.0) -> DataFrame:
    """(item, term, tf, reviews, df, n_items, dfr_weight, idf_weight) of terms in at least ``min_reviews`` records of
    the item and at most ``max_share`` (numerator, denominator) of all items. All counts cover the whole table."""
    counts = term_counts(records, id_col, group_col, text_col)
    lengths = counts.groupBy("item").agg(F.sum("tf").alias("dl"))
    whole = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = whole["n"], whole["avgdl"] or 1.0
    above, below = max_share
    used = counts.where(F.col("reviews") >= min_reviews)
    collection = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("reviews").alias("most")).where((F.col("df") * below <= above * n) & (F.col("most") >= min_reviews))
    rows = used.join(collection.drop("most"), "term").join(lengths, "item")
    tfn = F.col("tf") * F.log2(1 + F.lit(c * avgdl) / F.col("dl"))
    rate = F.col("cf") / F.lit(float(max(n, 1)))
    dfr = (F.log2(1 + rate) + tfn * F.log2(1 + 1 / rate)) / (1 + tfn)
    idf = (1 + F.log("tf")) * F.log(1 + F.lit(float(n)) / (1 + F.col("df")))
    return rows.select("item", "term", "tf", "reviews", "df", F.lit(n).cast("long").alias("n_items"), dfr.alias("dfr_weight"), idf.alias("idf_weight"))


def best_terms(weights: DataFrame, weight: str, n: int) -> DataFrame:
    """The ``n`` terms of each item with the largest weight (to nine places, so that sums in another order agree); ties go to the lesser term."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(F.round(weight, 9)), "term"))
    return weights.withColumn("rank", rank).where(F.col("rank") <= n)
