"""Rating prediction: shrunken priors, bias model, linear model by distributed gradient descent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.operators import stats

# Prior weights of the shrunken means and weights of the blended prior.
PRIOR = {"user": 4.0, "recent": 3.0, "item": 8.0, "category": 100.0, "user_category": 4.0}
BLEND = {"user_prior": 0.42, "item_prior": 0.38, "category_prior": 0.14}


def shrinkage(mean: Column, n: Column, prior: Column, weight: float) -> Column:
    """(mean*n + prior*weight)/(n + weight); the prior where n is 0 or null."""
    return F.when(F.coalesce(n, F.lit(0)) > 0, (mean * n + prior * weight) / (n + weight)).otherwise(prior)


def reliability(n: Column, weight: float) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) > 0, n / (n + weight)).otherwise(0.0)


def clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(1.0)), F.lit(5.0))


def features(targets: DataFrame, train: DataFrame) -> DataFrame:
    """``targets(review_id, user_id, item_id, category, rating)`` with means, counts and shrunken priors from ``train``.

    Unknown users, items and categories fall back to the global mean, unknown user-category pairs to the user.
    """
    g = train.agg(F.avg("rating").alias("m"), F.when(F.count("rating") < 2, 0.0).otherwise(F.stddev_pop("rating")).alias("s")).first()
    mean, std = F.lit(float(g["m"] if g["m"] is not None else 3.5)), F.lit(float(g["s"] or 0.0))

    def side(*keys: str) -> DataFrame:
        name = "_".join(k.removesuffix("_id") for k in keys)
        s = stats.rating_stats(train, *keys)
        return s.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in ("n", "mean", "std", "positive_share", "negative_share")))

    rows = targets.join(side("user_id"), "user_id", "left").join(stats.recent_means(train), "user_id", "left").join(side("item_id"), "item_id", "left").join(side("category"), "category", "left").join(side("user_id", "category"), ["user_id", "category"], "left")
    rows = rows.withColumns({"global_mean": mean, "user_mean": F.coalesce("user_mean", mean), "item_mean": F.coalesce("item_mean", mean), "category_mean": F.coalesce("category_mean", mean), "item_std": F.coalesce("item_std", std), "category_std": F.coalesce("category_std", std), "user_std": F.coalesce("user_std", F.lit(0.0))})
    rows = rows.withColumns({"user_category_mean": F.coalesce("user_category_mean", "user_mean"), "recent_mean": F.coalesce("recent_mean", "user_mean")})
    rows = rows.na.fill(0, [c for c in rows.columns if c.endswith(("_n", "_share"))])
    rows = rows.withColumns({
        "user_prior": shrinkage(F.col("user_mean"), F.col("user_n"), mean, PRIOR["user"]),
        "user_recent_prior": shrinkage(F.col("recent_mean"), F.least("user_n", F.lit(3)), mean, PRIOR["recent"]),
        "item_prior": shrinkage(F.col("item_mean"), F.col("item_n"), mean, PRIOR["item"]),
        "category_prior": shrinkage(F.col("category_mean"), F.col("category_n"), mean, PRIOR["category"]),
        "user_category_prior": shrinkage(F.col("user_category_mean"), F.col("user_category_n"), F.col("category_mean"), PRIOR["user_category"]),
    })
    bias = mean + reliability(F.col("user_n"), PRIOR["user"]) * (F.col("user_mean") - mean) + reliability(F.col("item_n"), PRIOR["item"]) * (F.col("item_mean") - mean) + reliability(F.col("category_n"), PRIOR["category"]) * (F.col("category_mean") - mean) + reliability(F.col("user_category_n"), PRIOR["user_category"]) * (F.col("user_category_mean") - F.col("category_mean"))
    return rows.withColumn("bias_prior", clamp(bias))


def predictions(featured: DataFrame) -> DataFrame:
    """Prediction heads side by side: global, user, item, user_item_bias, calibrated, bias_prior."""
    total = sum(BLEND.values())
    blend = sum((F.col(c) * (w / total) for c, w in BLEND.items()), F.lit(0.0))
    return featured.select(
        "review_id", "user_id", "item_id", "category", "rating", "user_n", "item_n",
        F.col("global_mean").alias("head_global"),
        F.col("user_mean").alias("head_user"),
        F.col("item_mean").alias("head_item"),
        clamp(F.col("user_mean") + F.col("item_mean") - F.col("global_mean")).alias("head_user_item_bias"),
        clamp(blend).alias("head_calibrated"),
        F.col("bias_prior").alias("head_bias_prior"),
        clamp(F.when(F.col("item_n") < 10, F.col("user_prior")).otherwise(0.4 * F.col("user_mean") + 0.6 * F.col("item_mean"))).alias("head_adaptive"),
    )


HEADS = ["head_global", "head_user", "head_item", "head_user_item_bias", "head_calibrated", "head_bias_prior", "head_adaptive"]


def fit_linear(rows: DataFrame, columns: Sequence[str], target: str = "rating", *, rate: float = 0.03, epochs: int = 80, l2: float = 0.001, loss: str = "mse", delta: float = 1.0) -> dict:
    """Full-batch gradient descent on standardised features around the mean target; step rate/(1+0.015*epoch); mse, mae or huber.

    Each epoch is one distributed aggregate over the rows; with ``mse`` the second moments are aggregated once and
    all epochs run on them, so the data are read twice in all. Without rows all weights are 0 and the mean is 3.5.
    """
    d = len(columns)
    x = [F.col(c).cast("double") for c in columns]
    moments = rows.agg(F.count("*").alias("n"), F.avg(target).alias("t"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(x)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x))).first()
    if not moments["n"]:
        return {"columns": list(columns), "means": [0.0] * d, "scales": [1.0] * d, "weights": [0.0] * d, "intercept": 3.5}
    means, scales = [moments[f"m{i}"] for i in range(d)], [max(moments[f"s{i}"], 1e-6) for i in range(d)]
    base, weights = float(moments["t"]), [0.0] * d
    z = [(c - m) / s for c, m, s in zip(x, means, scales)]
    y = F.col(target) - base
    if loss == "mse":
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        g = rows.agg(*(F.avg(z[i] * z[j]).alias(f"g{i}_{j}") for i, j in pairs), *(F.avg(z[i] * y).alias(f"b{i}") for i in range(d))).first()
        gram = [[g[f"g{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]
    for epoch in range(epochs):
        if loss == "mse":
            slopes = [sum(gram[i][j] * weights[j] for j in range(d)) - g[f"b{i}"] for i in range(d)]
        else:
            error = sum((z[i] * weights[i] for i in range(d)), F.lit(0.0)) - y
            slope = F.signum(error) if loss == "mae" else F.greatest(F.least(error, F.lit(delta)), F.lit(-delta))
            slopes = list(rows.agg(*(F.avg(slope * c) for c in z)).first())
        weights = [w - rate / (1 + 0.015 * epoch) * (s + l2 * w) for w, s in zip(weights, slopes)]
    return {"columns": list(columns), "means": means, "scales": scales, "weights": weights, "intercept": base}


def predict_linear(rows: DataFrame, model: dict, name: str = "predicted") -> DataFrame:
    score = F.lit(model["intercept"])
    for c, m, s, w in zip(model["columns"], model["means"], model["scales"], model["weights"]):
        score = score + (F.col(c).cast("double") - m) / s * w
    return rows.withColumn(name, clamp(score))


def star_thresholds(scored: DataFrame, score: str, target: str = "rating", bins: int = 300) -> list[float]:
    """Four thresholds between stars that minimise the absolute error of ``score`` cut into stars.

    Rows are counted per score bucket by the cluster (at most ``bins`` buckets of equal size in score order); the dynamic
    program over stars and buckets runs on those counts. Fewer than five rows give the half points.
    """
    n = scored.count()
    if n < 5:
        return [1.5, 2.5, 3.5, 4.5]
    size = max(1, -(-n // bins)) if n > bins else 1
    ordered = stats.ranked_globally(scored.select(F.col(score).alias("s"), F.least(F.greatest(F.bround(target, 0), F.lit(1.0)), F.lit(5.0)).cast("int").alias("y")), [F.col("s"), F.col("y")], "place")
    buckets = ordered.groupBy(F.floor((F.col("place") - 1) / size).alias("b")).agg(F.avg("s").alias("s"), *(F.sum((F.col("y") == r).cast("long")).alias(f"r{r}") for r in range(1, 6))).orderBy("b").collect()
    m = len(buckets)
    cost = [[0.0] * (m + 1) for _ in range(6)]  # cost[star][e]: absolute error of the first e buckets if all were that star
    for star in range(1, 6):
        for e, row in enumerate(buckets, 1):
            cost[star][e] = cost[star][e - 1] + sum(row[f"r{r}"] * abs(r - star) for r in range(1, 6))
    best, cuts = [0.0] + [float("inf")] * m, []
    for star in range(1, 6):
        new, back = [float("inf")] * (m + 1), [0] * (m + 1)
        lead, lead_at = float("inf"), 0
        for e in range(star, m + 1):
            # the least of best[start] - cost[star][start] over start < e; the first one on ties
            if best[e - 1] - cost[star][e - 1] < lead:
                lead, lead_at = best[e - 1] - cost[star][e - 1], e - 1
            new[e], back[e] = lead + cost[star][e], lead_at
        best = new
        cuts.append(back)
    end, edges = m, []
    for star in range(5, 1, -1):
        end = cuts[star - 1][end]
        edges.append(end)
    out, previous = [], 1.0
    for edge in reversed(edges):
        value = 1.0 if edge <= 0 else 5.0 if edge >= m else (buckets[edge - 1]["s"] + buckets[edge]["s"]) / 2
        previous = min(max(value, previous + 1e-4), 5.0)
        out.append(round(previous, 6))
    return out


def stars(score: Column, thresholds: Sequence[float]) -> Column:
    """1 plus the number of thresholds that the score reaches."""
    return F.lit(1) + sum((F.when(score >= t, 1).otherwise(0) for t in thresholds), F.lit(0))


def fit_blend(rows: DataFrame, heads: Sequence[str], target: str = "rating", step: float = 0.05) -> dict[str, float]:
    """Weights on the simplex grid with the least RMSE; the error of every grid point follows from one aggregate of
    second moments, so the rows are read once whatever the grid. Ties go to the first point in enumeration order."""
    d, units = len(heads), max(1, round(1 / step))
    y = F.col(target)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    m = rows.agg(F.count("*").alias("n"), *(F.avg(F.col(heads[i]) * F.col(heads[j])).alias(f"g{i}_{j}") for i, j in pairs), *(F.avg(F.col(h) * y).alias(f"b{i}") for i, h in enumerate(heads)), F.avg(y * y).alias("c")).first()
    if not m["n"]:
        return {heads[0]: 1.0}

    def points(parts: int, left: int):
        if parts == 1:
            yield (left,)
            return
        for v in range(left + 1):
            for tail in points(parts - 1, left - v):
                yield (v, *tail)

    best, found = float("inf"), (units, *[0] * (d - 1))
    for p in points(d, units):
        w = [v / units for v in p]
        error = m["c"] + sum(w[i] * w[j] * m[f"g{i}_{j}"] * (1 if i == j else 2) for i, j in pairs if w[i] and w[j]) - 2 * sum(w[i] * m[f"b{i}"] for i in range(d))
        if error < best - 1e-12:
            best, found = error, p
    return {h: v / units for h, v in zip(heads, found) if v}
