"""Distances within structures.

``radius_join`` is an equality join on grid cells: points of one side go to the
27 cells around them, so a pair within the radius meets in one cell, and no pair
of distant points is ever formed.  A structure, or a region of one, of any size
is spread over its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def radius_join(left: DataFrame, right: DataFrame, keys: list[str], radius: float, prefix: str = "to_") -> DataFrame:
    """Pairs within the radius (inclusive): left's columns, right's with a prefix, and ``distance``.  Points are x, y, z."""
    far = right.select(*keys, *[F.col(c).alias(prefix + c) for c in right.columns if c not in keys])
    cell = lambda c: F.floor(F.col(c) / radius)
    near = lambda c: F.sequence(cell(c) - 1, cell(c) + 1)
    a = left.withColumns({"_cx": cell("x"), "_cy": cell("y"), "_cz": cell("z")})
    b = far.withColumn("_cx", F.explode(near(prefix + "x"))).withColumn("_cy", F.explode(near(prefix + "y"))).withColumn("_cz", F.explode(near(prefix + "z")))
    square = sum((F.col(c) - F.col(prefix + c)) * (F.col(c) - F.col(prefix + c)) for c in "xyz")
    return a.join(b, [*keys, "_cx", "_cy", "_cz"]).withColumn("_d2", square).where(F.col("_d2") <= radius * radius).withColumn("distance", F.sqrt("_d2")).drop("_cx", "_cy", "_cz", "_d2")


def neighbour_sums(points: DataFrame, keys: list[str], identity: str, radius: float, value: str, name: str = "total") -> DataFrame:
    """Sum of value over the other points within the radius, 0 where there are none."""
    pairs = radius_join(points, points, keys, radius).where(F.col(identity) != F.col(f"to_{identity}"))
    sums = pairs.groupBy(*keys, identity).agg(F.sum(f"to_{value}").alias(name))
    return points.join(sums, [*keys, identity], "left").na.fill(0.0, [name])


def vicinity(points: DataFrame, keys: list[str], residue: list[str], centre: Column, radius: float) -> DataFrame:
    """Distinct residues with a point within the radius of a centre point; centres are in."""
    hits = radius_join(points.where(centre).select(*keys, "x", "y", "z"), points.select(*keys, *residue, "x", "y", "z"), keys, radius)
    return hits.select(*keys, *[F.col(f"to_{c}").alias(c) for c in residue]).distinct()


def shell_pairs(points: DataFrame, keys: list[str], identity: str, shells: list[tuple[float, float]]) -> DataFrame:
    """keys, shell (its start), pairs: unordered pairs whose distance lies in [start, start + width)."""
    reach = max(a + w for a, w in shells)
    pairs = radius_join(points, points, keys, reach).where(F.col(identity) < F.col(f"to_{identity}"))
    counts = pairs.groupBy(*keys).agg(*[F.count_if((F.col("distance") >= a) & (F.col("distance") < a + w)).alias(f"s{i}") for i, (a, w) in enumerate(shells)])
    return counts.select(*keys, F.explode(F.array(*[F.struct(F.lit(a).alias("shell"), F.col(f"s{i}").alias("pairs")) for i, (a, _) in enumerate(shells)])).alias("_")).select(*keys, "_.*")


def planarity_moments(points: DataFrame, keys: list[str], identity: str, radius: float, least: int = 4) -> DataFrame:
    """The six covariances of the points around each point (itself included), where there are enough."""
    pairs = radius_join(points, points, keys, radius)
    pair = lambda a, b: F.covar_pop(f"to_{a}", f"to_{b}").alias(a + b)
    return pairs.groupBy(*keys, identity).agg(F.count("*").alias("n"), *[pair(a, b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]).where(F.col("n") >= least)


def smallest_eigenvalue_share(m: DataFrame) -> DataFrame:
    """m with ``planarity``: the least eigenvalue of a symmetric 3 x 3 matrix over its trace, in closed form."""
    q = (F.col("xx") + F.col("yy") + F.col("zz")) / 3.0
    off = F.col("xy") ** 2 + F.col("xz") ** 2 + F.col("yz") ** 2
    p = F.sqrt(((F.col("xx") - q) ** 2 + (F.col("yy") - q) ** 2 + (F.col("zz") - q) ** 2 + 2 * off) / 6.0)
    a, b, c = ((F.col(k) - F.col("_q")) / F.col("_p") for k in ("xx", "yy", "zz"))
    d, e, f = (F.col(k) / F.col("_p") for k in ("xy", "xz", "yz"))
    det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2.0))
    least = F.col("_q") + 2 * F.col("_p") * F.cos(F.acos(r) / 3.0 + 2.0943951023931953)
    share = F.when(F.col("_q") <= 0, 0.0).when(F.col("_p") <= 0, F.lit(1.0 / 3.0)).otherwise(F.greatest(F.lit(0.0), least) / (3 * F.col("_q")))
    return m.withColumns({"_q": q, "_p": p}).withColumn("planarity", share).drop("_q", "_p")
