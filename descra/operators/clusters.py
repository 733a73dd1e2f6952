"""Clusters of points within a structure, their sums, and sampling against a random surface.

Kernels here work on one structure's residues (some hundreds), so a group in
``applyInPandas`` is bounded by the molecule, not by the number of structures.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descra.functions import chemistry as ch


def entropy(df: DataFrame, keys: list[str], part: str, weight: str) -> DataFrame:
    """keys, total, entropy (natural log) of the parts' shares of weight."""
    sums = df.groupBy(*keys, part).agg(F.sum(weight).alias("_v")).where("_v > 0")
    # -sum(v/T ln(v/T)) = ln T - sum(v ln v)/T: one more grouping, no join.
    return sums.groupBy(*keys).agg(F.sum("_v").alias("total"), F.sum(F.col("_v") * F.log("_v")).alias("_e")).select(*keys, "total", (F.log("total") - F.col("_e") / F.col("total")).alias("entropy"))


def neighbours(xyz: np.ndarray, radius: float) -> np.ndarray:
    return ((xyz[:, None] - xyz[None]) ** 2).sum(2) <= radius * radius


def dbscan(xyz: np.ndarray, radius: float, least: int) -> np.ndarray:
    """Labels from 0 in order of the first core point; -1 is noise; a border point joins the first cluster that reaches it."""
    near = neighbours(xyz, radius) if len(xyz) else np.zeros((0, 0), bool)
    core, labels, n = near.sum(1) >= least, np.full(len(xyz), -1), 0
    for i in range(len(xyz)):
        if labels[i] >= 0 or not core[i]:
            continue
        labels[i], todo = n, [i]
        while todo:
            j = todo.pop()
            if core[j]:
                new = np.flatnonzero(near[j] & (labels < 0))
                labels[new] = n
                todo += new.tolist()
        n += 1
    return labels


def cluster(df: DataFrame, keys: list[str], radius: float, least: int, order: str) -> DataFrame:
    """df with ``cluster`` for its points x, y, z, in order of ``order`` within the keys."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(cluster=dbscan(pdf[["x", "y", "z"]].to_numpy(float), radius, least).astype("int32"))

    return df.groupBy(*keys).applyInPandas(run, df.withColumn("cluster", F.lit(0)).schema)


def patches(clustered: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """keys, total and entropy of clusters' weight, noise left out."""
    return entropy(clustered.where("cluster >= 0"), keys, "cluster", weight)


def hull_volume(xyz: np.ndarray) -> float:
    """Volume of the convex hull by adding points one by one; 0 under four points or where they are flat."""
    xyz = np.unique(np.asarray(xyz, float).reshape(-1, 3), axis=0)
    if len(xyz) < 4:
        return 0.0
    size = np.ptp(xyz, axis=0).max()
    eps = 1e-10 * max(size, 1e-30)
    a = 0
    b = int(((xyz - xyz[a]) ** 2).sum(1).argmax())
    line = np.linalg.norm(np.cross(xyz - xyz[a], xyz[b] - xyz[a]), axis=1)
    c = int(line.argmax())
    normal = np.cross(xyz[b] - xyz[a], xyz[c] - xyz[a])
    height = (xyz - xyz[a]) @ normal
    d = int(np.abs(height).argmax())
    if line[c] <= eps * size or abs(height[d]) <= eps * size * size:
        return 0.0
    centre = xyz[[a, b, c, d]].mean(0)

    def facing(i, j, k):
        n = np.cross(xyz[j] - xyz[i], xyz[k] - xyz[i])
        return (i, j, k) if n @ (xyz[i] - centre) > 0 else (i, k, j)

    faces = {facing(*f) for f in ((a, b, c), (a, b, d), (a, c, d), (b, c, d))}
    for p in range(len(xyz)):
        if p in (a, b, c, d):
            continue
        seen = {f for f in faces if np.cross(xyz[f[1]] - xyz[f[0]], xyz[f[2]] - xyz[f[0]]) @ (xyz[p] - xyz[f[0]]) > eps * size * size}
        if not seen:
            continue
        edges = {(f[i], f[(i + 1) % 3]) for f in seen for i in range(3)}
        faces -= seen
        faces |= {(i, j, p) for i, j in edges if (j, i) not in edges}
    return float(sum((xyz[i] - centre) @ np.cross(xyz[j] - centre, xyz[k] - centre) for i, j, k in faces) / 6)


def shell_counts(xyz: np.ndarray, shells) -> np.ndarray:
    if len(xyz) < 2:
        return np.zeros(len(shells))
    i, j = np.triu_indices(len(xyz), 1)
    d = np.sqrt(((xyz[i] - xyz[j]) ** 2).sum(1))
    return np.array([((d >= a) & (d < a + w)).sum() for a, w in shells], float)


def surface_enrichment(all_xyz: np.ndarray, classes: dict[str, np.ndarray], shells=ch.SHELLS, draws: int = ch.NULL_DRAWS, seed: int = 42) -> dict[tuple[str, int], float]:
    """For each class (indices of points) and shell: its pairs over the mean of as many random surface points.

    One generator serves the classes in order; a class with fewer than two points draws nothing and scores 0.
    """
    rng, out = np.random.default_rng(seed), {}
    volume = hull_volume(all_xyz) if len(all_xyz) > 1 else 0.0
    for name, index in classes.items():
        scores = np.zeros(len(shells))
        if volume > 0 and len(index) >= 2:
            mean = np.zeros(len(shells))
            for _ in range(draws):
                mean += shell_counts(all_xyz[rng.choice(len(all_xyz), len(index), replace=False)], shells)
            mean /= draws
            seen = shell_counts(all_xyz[index], shells)
            scores = np.divide(seen, mean, out=np.zeros(len(shells)), where=mean > 0)
        out |= {(name, k): float(s) for k, s in enumerate(scores)}
    return out


def charge_at(pka: np.ndarray, acid: np.ndarray, ph: float) -> float:
    return float(np.where(acid, -1 / (1 + 10.0 ** (pka - ph)), 1 / (1 + 10.0 ** (ph - pka))).sum())


def isoelectric_point(pka: np.ndarray, acid: np.ndarray) -> float | None:
    """The pH in [0, 14] without net charge, by bisection; None where both ends have one sign."""
    low, high = 0.0, 14.0
    a, b = charge_at(pka, acid, low), charge_at(pka, acid, high)
    if a == 0 or b == 0:
        return low if a == 0 else high
    if (a > 0) == (b > 0):
        return None
    while high - low > 1e-12:
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if (charge_at(pka, acid, middle) > 0) == (a > 0):
            low = middle
        else:
            high = middle
    return (low + high) / 2


def hydrogen_bonds(donors: list[dict], acceptors: list[dict]) -> list[tuple[int, int]]:
    """Greedy pairs (donor, acceptor) within capacities, in the donors' file order and for each the acceptors' file order.

    An item has xyz, base (or None), capacity, residue, chain, seq_idx and backbone.  The acceptor order is our
    choice: a tree search has none.
    """
    if not donors or not acceptors:
        return []
    at = np.array([x["xyz"] for x in acceptors], float)
    left, out = [x["capacity"] for x in acceptors], []
    for i, d in enumerate(donors):
        if d["base"] is None:
            continue  # no angle, no bond
        mine = d["capacity"]
        away = at - np.array(d["xyz"], float)
        for j in np.flatnonzero((away**2).sum(1) <= ch.HBOND**2):
            a = acceptors[j]
            if mine == 0:
                break
            if not left[j] or a["residue"] == d["residue"]:
                continue
            if d["backbone"] and a["backbone"] and d["chain"] == a["chain"] and abs(d["seq_idx"] - a["seq_idx"]) < ch.BACKBONE_APART:
                continue
            # The angle at the donor must be 120 degrees or more.
            back = np.array(d["base"], float) - np.array(d["xyz"], float)
            dot = float(back @ away[j])
            if dot > 0 or dot * dot < ch.HBOND_COSINE**2 * float(back @ back) * float(away[j] @ away[j]):
                continue
            mine -= 1
            left[j] -= 1
            out.append((i, int(j)))
    return out
