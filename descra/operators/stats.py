"""Ranks, correlations, scaling and feature screens as joins, groupings and windows.

No window holds a whole group: ranks and running sums go through counts of
distinct values in value buckets, so a group with most of the rows is spread.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descra.operators.columns import quoted

#: Buckets of a group, and about how many of its distinct values place their bounds.
BUCKETS, BOUND_VALUES = 256, 8192


def running_counts(df: DataFrame, keys: list[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """keys, value, n (rows with the value), below (rows of the group with a lesser value)."""
    return _running(df, keys, value, buckets).drop("_bucket")


def _running(df: DataFrame, keys: list[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """running_counts with _bucket, which rises with the value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    # Bounds are quantiles of the distinct values whose hash is low: the same ones whenever a task is run again, as an approximate percentile's are not.
    sizes = counts.groupBy(*keys).agg(F.count("*").alias("_size"))
    low = F.pmod(F.xxhash64(value), F.lit(1 << 30)).cast("double") * F.col("_size") < float(BOUND_VALUES << 30)
    some = _with(counts, sizes, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(low, F.col(value).cast("double")))).alias("_some"))
    at = lambda i: F.get("_some", F.floor(i * F.size("_some") / buckets).cast("int"))
    bounds = some.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), at).alias("_bounds"))
    # A binary search among the bounds.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((buckets - 1).bit_length()))])
    reached = lambda pos, step: F.get("_bounds", pos + step - 1) <= F.col(value).cast("double")
    bucket = F.aggregate(steps, F.lit(0), lambda pos, step: F.when(reached(pos, step), pos + step).otherwise(pos))
    counts = _with(counts, bounds, keys).withColumn("_bucket", bucket).drop("_bounds")
    totals = counts.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return _with(counts, bases, [*keys, "_bucket"]).select(*keys, value, "n", (F.col("_base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("below"), "_bucket")


def _with(df: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """df with right's columns by keys, where null is a key like any other."""
    if not keys:
        return df.crossJoin(F.broadcast(right))  # one row
    right = right.select(*[F.col(k).alias(f"_r{i}") if k in keys else F.col(k) for i, k in enumerate(right.columns)])
    on = [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)]
    return df.join(right, on).drop(*[f"_r{i}" for i in range(len(keys))])


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with the average rank of value in its group; nulls have none."""
    ranks = running_counts(df, keys, value).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(value).alias("_v"), (F.col("below") + (F.col("n") + 1) / 2.0).alias(name))
    on = df[value] == ranks["_v"]
    for i, k in enumerate(keys):
        on = on & df[k].eqNullSafe(ranks[f"_k{i}"])
    return df.join(ranks, on, "left").select(*df.columns, name)


def metrics(df: DataFrame, keys: list[str], y: str, yhat: str, ranked: bool = True) -> DataFrame:
    """n, spearman, pearson, r2, mse by group over finite pairs; null under two pairs or with a constant side."""
    own = df.select(*keys, F.col(y).cast("double").alias("_y"), F.col(yhat).cast("double").alias("_p"))
    ok = own.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) <> double('infinity')" for c in ("_y", "_p")))
    if ranked:
        ok = average_rank(average_rank(ok, keys, "_y", "_ry"), keys, "_p", "_rp")
    n = F.count("*")
    good = (n >= 2) & (F.max("_y") > F.min("_y")) & (F.max("_p") > F.min("_p"))
    sse = F.sum(F.pow(F.col("_y") - F.col("_p"), F.lit(2)))
    out = [n.alias("n"), F.when(good, _corr("_y", "_p")).alias("pearson"), F.when(good, 1 - F.try_divide(sse, F.var_pop("_y") * n)).alias("r2"), F.when(good, F.try_divide(sse, n)).alias("mse")]
    if ranked:
        out.insert(1, F.when(good, _corr("_ry", "_rp")).alias("spearman"))
    return (ok.groupBy(*keys) if keys else ok).agg(*out)


def _corr(a, b) -> Column:
    """corr, but null where a side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def p_value(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation by Student's t, through the incomplete beta function."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    return incomplete_beta(df / 2, 0.5, df / (df + r * r * df / (1 - r * r)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            c = 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def correlations(df: DataFrame, columns: list[str], least: int = 3, spearman: bool = False) -> DataFrame:
    """a, b, r, n of every pair of columns over rows where both are there.

    Pearson is one pass with two sums per pair.  Spearman ranks each pair anew,
    since a missing partner changes ranks.
    """
    pairs = list(combinations(columns, 2))
    if spearman:
        parts = [metrics(df.select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("_1"), F.col(b).alias("_2")), ["a", "b"], "_1", "_2").select("a", "b", F.when(F.col("n") >= least, F.col("spearman")).alias("r"), "n") for a, b in pairs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    sums = [x for i, (a, b) in enumerate(pairs) for x in (_corr(F.when(both(a, b), F.col(a).cast("double")), F.when(both(a, b), F.col(b).cast("double"))).alias(f"r{i}"), F.count_if(both(a, b)).alias(f"n{i}"))]
    row = df.agg(*sums)
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.col(f"n{i}") >= least, F.col(f"r{i}")).alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])).alias("_")).select("_.*")


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, name: str = "q") -> DataFrame:
    """df with adjusted p values: the least n * p / rank from the row's rank on, 1 at most; nulls stay null."""
    ranks = _running(df, keys, p)
    total = ranks.groupBy(*keys).agg(F.sum("n").alias("_all"))
    # Equal p values share the largest of their ranks: that one has the least ratio.
    ratio = _with(ranks, total, keys).withColumn("_ratio", F.col(p) * F.col("_all") / (F.col("below") + F.col("n")))
    # The least ratio of the buckets above, one row for each bucket, then of the values from this one on in its own.
    above = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    least = ratio.groupBy(*keys, "_bucket").agg(F.min("_ratio").alias("_least")).select(*keys, "_bucket", F.min("_least").over(above).alias("_above"))
    after = Window.partitionBy(*keys, "_bucket").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    ratio = _with(ratio, least, [*keys, "_bucket"])
    done = ratio.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(p).alias("_p"), F.least(F.lit(1.0), F.min("_ratio").over(after), "_above").alias(name))
    on = df[p] == done["_p"]
    for i, k in enumerate(keys):
        on = on & df[k].eqNullSafe(done[f"_k{i}"])
    return df.join(done, on, "left").select(*df.columns, name)


def scaling(df: DataFrame, columns: list[str], train: Column | None = None) -> DataFrame:
    """One row: min, max, population std and mean of each column over the train rows."""
    at = lambda c: F.when(train, F.col(quoted(c))) if train is not None else F.col(quoted(c))
    return df.agg(*[f(at(c)).alias(f"{c}__{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_pop), ("mean", F.avg))])


def min_max(df: DataFrame, columns: list[str], train: Column | None = None) -> DataFrame:
    """Columns scaled to the train rows' range; a constant column is 0."""
    known = df.crossJoin(F.broadcast(scaling(df, columns, train)))  # one row
    of = lambda c, n: F.col(quoted(f"{c}__{n}"))
    scaled = lambda c: F.coalesce(F.try_divide(F.col(quoted(c)) - of(c, "lo"), of(c, "hi") - of(c, "lo")), F.when(F.col(quoted(c)).isNotNull(), F.lit(0.0)))
    return known.select(*[scaled(c).alias(c) if c in columns else F.col(quoted(c)) for c in df.columns])


def relative_spread(df: DataFrame, columns: list[str], least: float = 0.01) -> DataFrame:
    """feature, spread (population std over the absolute mean, after min-max scaling), keep."""
    row = scaling(df, columns)
    of = lambda c, n: F.col(quoted(f"{c}__{n}"))
    width = lambda c: of(c, "hi") - of(c, "lo")
    spread = lambda c: F.coalesce(F.try_divide(of(c, "sd"), width(c)) / (F.abs(F.try_divide(of(c, "mean") - of(c, "lo"), width(c))) + 1e-8), F.lit(0.0))
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), spread(c).alias("spread")) for c in columns])).alias("_")).select("_.*").withColumn("keep", F.col("spread") >= least)


def mode(column: str) -> Column:
    """The most frequent value, the least one in a tie."""
    return F.mode(F.col(column), True)


def mean_jaccard(sets: DataFrame, keys: list[str], member: str, features: str) -> DataFrame:
    """Mean Jaccard similarity of all pairs of a group's non-empty sets; null under two. sets holds a row for each fold."""
    # Equal sets are one class with a count: pairs are formed of classes, of which few sets of features make few.
    alike = sets.where(F.size(features) > 0).groupBy(*keys, F.array_sort(F.array_distinct(features)).alias("_x")).agg(F.countDistinct(member).cast("double").alias("_n"))
    left, right = alike, alike.select(*keys, F.col("_x").alias("_y"), F.col("_n").alias("_m"))
    each = F.size(F.array_intersect("_x", "_y")) / F.size(F.array_union("_x", "_y"))
    apart = left.join(right, keys).where("_x < _y").groupBy(*keys).agg(F.sum(each * F.col("_n") * F.col("_m")).alias("_apart"))
    total = alike.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.sum(F.col("_n") * (F.col("_n") - 1) / 2).alias("_same"))
    mean = F.try_divide(F.col("_same") + F.coalesce("_apart", F.lit(0.0)), F.col("_all") * (F.col("_all") - 1) / 2)
    return sets.select(*keys).distinct().join(total.join(apart, keys, "left").select(*keys, mean.alias("jaccard")), keys, "left")


def votes(runs: DataFrame, features: str, most: int | None = None) -> DataFrame:
    """How many runs chose each feature, most first, then by name; the first ``most`` of them if that is given."""
    out = runs.select(F.explode(F.array_distinct(features)).alias("feature")).groupBy("feature").agg(F.count("*").alias("votes")).orderBy(F.desc("votes"), "feature")
    return out if most is None else out.limit(most)


def elbow(df: DataFrame, name: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Rows up to the one farthest from the chord between first and last by descending score (names break ties).

    df holds one row for each feature of a group, so a group is small.
    """
    keys = keys or []
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(name))
    whole = Window.partitionBy(*keys)
    ranked = df.withColumn("_i", F.row_number().over(order) - 1).withColumns({"_n": F.count("*").over(whole), "_first": F.max(score).over(whole), "_last": F.min(score).over(whole)})
    far = F.abs((F.col("_last") - F.col("_first")) * F.col("_i") - (F.col("_n") - 1) * (F.col(score) - F.col("_first")))
    ranked = ranked.withColumn("_far", far)
    cut = ranked.groupBy(*keys).agg(F.max_by("_i", F.struct("_far", -F.col("_i"))).alias("_cut"))
    return _with(ranked, cut, keys).where("_i <= _cut or _n < 3").select(*df.columns)


def prune_pairs(pairs: list[tuple[str, str, float | None]], with_target: dict[str, float | None], threshold: float = 0.9) -> list[str]:
    """Features that stay when, of the strongest pair again and again, the one that says less about the target goes.

    Works on a matrix of features, not on data.  Ties go by name.
    """
    left = {x for a, b, _ in pairs for x in (a, b)} | set(with_target)
    strong = sorted(((-abs(r), min(a, b), max(a, b)) for a, b, r in pairs if r is not None and not math.isnan(r) and abs(r) >= threshold))
    for _, a, b in strong:
        if a in left and b in left:
            worth = lambda x: (-abs(with_target.get(x) or 0.0), x)
            left.discard(max((a, b), key=worth))
    return sorted(left)


def prune_clusters(names: list[str], pairs: list[tuple[str, str, float | None]], with_target: dict[str, float | None], threshold: float = 0.9) -> list[str]:
    """The best feature of each cluster of average linkage over 1 - |r|, cut at 1 - threshold."""
    r = {frozenset((a, b)): abs(v or 0.0) for a, b, v in pairs}
    clusters = [[n] for n in sorted(names)]
    while len(clusters) > 1:
        apart = lambda x, y: sum(1 - r.get(frozenset((a, b)), 0.0) for a in x for b in y) / (len(x) * len(y))
        d, i, j = min((apart(clusters[i], clusters[j]), i, j) for i, j in combinations(range(len(clusters)), 2))
        if d > 1 - threshold:
            break
        clusters[i] += clusters.pop(j)
    return sorted(min(c, key=lambda x: (-abs(with_target.get(x) or 0.0), x)) for c in clusters)


def target_screen(df: DataFrame, features: list[str], target: str, most_q: float = 0.05, least_r: float = 0.0) -> DataFrame:
    """feature, r, n, p, q of features whose rank correlation with the target holds after adjustment (q below most_q), strongest first."""
    spark = df.sparkSession
    parts = None
    for f in features:
        one = metrics(df.select(F.lit(f).alias("feature"), F.col(f).alias("_1"), F.col(target).alias("_2")), ["feature"], "_1", "_2").select("feature", F.col("spearman").alias("r"), "n")
        parts = one if parts is None else parts.unionByName(one)
    rows = [(r.feature, r.r, r.n, p_value(r.r, r.n)) for r in parts.collect()]  # a row for each feature
    table = spark.createDataFrame(rows, "feature string, r double, n long, p double")
    return benjamini_hochberg(table, [], "p").where((F.col("q") < most_q) & (F.abs("r") >= least_r)).orderBy(F.desc(F.abs("r")), "feature")
