"""Regression models and feature selection in numpy, for tasks whose training matrix fits a worker.

No model forms all pairs of rows: beside the matrix and the model itself memory is in proportion to the rows.

Every model takes plain arrays and is a dict of plain parameters, so a fitted
model is data that any process can read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

MODELS = ("linear", "elasticnet", "svm", "knn", "randomforest")


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks."""
    values, index, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[index]


def scores(y, yhat) -> dict[str, float | None]:
    """spearman, pearson, r2, mse, n over finite pairs; None under two pairs or for a constant side."""
    y, p = np.asarray(y, float), np.asarray(yhat, float)
    ok = np.isfinite(y) & np.isfinite(p)
    y, p = y[ok], p[ok]
    if len(y) < 2 or np.ptp(y) == 0 or np.ptp(p) == 0:
        return {"spearman": None, "pearson": None, "r2": None, "mse": None, "n": len(y)}
    correlation = lambda a, b: float(np.corrcoef(a, b)[0, 1])
    sse = float(((y - p) ** 2).sum())
    return {"spearman": correlation(ranks(y), ranks(p)), "pearson": correlation(y, p), "r2": 1 - sse / float(((y - y.mean()) ** 2).sum()), "mse": sse / len(y), "n": len(y)}


def fit_linear(x: np.ndarray, y: np.ndarray) -> dict:
    centre = x.mean(0)
    coef = np.linalg.lstsq(x - centre, y - y.mean(), rcond=None)[0]
    return {"coef": coef, "intercept": float(y.mean() - centre @ coef)}


def fit_elasticnet(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, l1_ratio: float = 0.5, steps: int = 100_000, tol: float = 1e-5) -> dict:
    """Least |y - xb|^2 / 2n + alpha l1 |b| + alpha (1 - l1) |b|^2 / 2 on columns of mean 0 and population deviation 1, by coordinate descent."""
    n = len(x)
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, 1.0)
    z, r = (x - mean) / sd, y - y.mean()
    b, square = np.zeros(x.shape[1]), (z * z).sum(0)
    gram, zy = z.T @ z, z.T @ r
    l1, l2, limit = alpha * l1_ratio * n, alpha * (1 - l1_ratio) * n, tol * float(r @ r)
    for _ in range(steps):
        largest = change = 0.0
        for j in range(len(b)):
            if square[j] == 0:
                continue
            rho = zy[j] - gram[j] @ b + square[j] * b[j]
            new = math.copysign(max(abs(rho) - l1, 0.0), rho) / (square[j] + l2)
            change, largest = max(change, abs(new - b[j])), max(largest, abs(new))
            b[j] = new
        if largest == 0 or change <= tol * largest:
            residual = r - z @ b
            # The duality gap tells whether the step is small because it is done.
            dual = z.T @ residual - l2 * b
            top = float(np.abs(dual).max(initial=0.0))
            scale = min(1.0, l1 / top) if top > 0 else 1.0
            gap = 0.5 * float(residual @ residual) * (1 + scale * scale) + l1 * float(np.abs(b).sum()) - scale * float(residual @ r) + 0.5 * l2 * (1 + scale * scale) * float(b @ b)
            if gap <= limit or largest == 0:
                break
    coef = b / sd
    return {"coef": coef, "intercept": float(y.mean() - mean @ coef), "scaled_coef": b}


def svm_start(x: np.ndarray, y: np.ndarray, c: float, epsilon: float, least: float) -> np.ndarray:
    """Dual variables (alpha - alpha*) near those of the linear epsilon-insensitive regression; they sum to 0.

    Newton steps on the loss with its corners rounded off over a width that falls to ``least``.  The derivatives of the
    rounded loss are dual variables whose largest violation is that width.
    """
    n = len(x)
    z = np.column_stack([x, np.ones(n)])
    ridge = np.append(np.ones(x.shape[1]), 0.0)
    w = np.append(np.zeros(x.shape[1]), np.median(y))
    width = max(float(np.ptp(y)), least)
    beta = np.zeros(n)

    def at(w: np.ndarray, width: float) -> tuple[float, np.ndarray, np.ndarray]:
        r = y - z @ w
        over = np.clip((np.abs(r) - epsilon) / width, 0.0, None)
        part = np.minimum(over, 1.0)
        return 0.5 * float(ridge @ (w * w)) + c * width * float((part * (over - 0.5 * part)).sum()), c * part * np.sign(r), (over > 0) & (over < 1)

    while True:
        value, beta, bent = at(w, width)
        for _ in range(50):
            slope = ridge * w - z.T @ beta
            if np.abs(slope).max() <= 1e-9 * c * n:
                break
            own = z[bent]
            bend = np.diag(ridge + 1e-9) + c / width * (own.T @ own)
            step, size = np.linalg.solve(bend, slope), 1.0
            # Near the end the value says nothing below its own rounding; the slope does.
            while size > 1e-6 and not ((found := at(w - size * step, width))[0] < value or np.abs(ridge * (w - size * step) - z.T @ found[1]).max() < 0.5 * np.abs(slope).max()):
                size /= 2
            if size <= 1e-6:
                break
            w = w - size * step
            value, beta, bent = found
        if width <= least:
            break
        width = max(width / 4, least)
    # What rounding leaves of the sum goes to variables that have room, those between their bounds first.
    for i in np.argsort(np.abs(beta) >= c, kind="stable"):
        rest = float(beta.sum())
        if abs(rest) <= 1e-12 * c * n:
            break
        beta[i] = min(max(beta[i] - rest, -c), c)
    return beta


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epsilon: float = 0.1, tol: float = 1e-3, steps: int = 200_000) -> dict:
    """Linear epsilon-insensitive regression: the dual by pairs of the largest violation.

    Of the products of all rows with all rows only the two columns of a pair are there at a time.  Where rows are many
    for their columns, the pairs start from ``svm_start``.
    """
    n = len(x)
    # Two variables a point: beta = alpha - alpha*; gradients of the dual for each.
    beta = svm_start(x, y, c, epsilon, tol / 4) if n > 4 * x.shape[1] else np.zeros(n)
    alpha = np.concatenate([np.maximum(beta, 0.0), np.maximum(-beta, 0.0)])
    sign = np.concatenate([np.ones(n), -np.ones(n)])
    made = x @ (x.T @ beta)
    gradient = np.concatenate([epsilon - y + made, epsilon + y - made])
    for _ in range(max(steps, 100 * n)):
        score = -sign * gradient
        up = ((sign > 0) & (alpha < c)) | ((sign < 0) & (alpha > 0))
        low = ((sign > 0) & (alpha > 0)) | ((sign < 0) & (alpha < c))
        i, j = int(np.where(up, score, -np.inf).argmax()), int(np.where(low, score, np.inf).argmin())
        if score[i] - score[j] < tol:
            break
        apart = x[i % n] - x[j % n]
        eta = max(float(apart @ apart), 1e-12)
        step = (score[i] - score[j]) / eta
        step = min(step, c - alpha[i] if sign[i] > 0 else alpha[i], alpha[j] if sign[j] > 0 else c - alpha[j])
        alpha[i] += sign[i] * step
        alpha[j] -= sign[j] * step
        change = step * (x @ apart)
        gradient += sign * np.concatenate([change, change])
    beta = alpha[:n] - alpha[n:]
    score = -sign * gradient
    free = (alpha > 0) & (alpha < c)
    up = ((sign > 0) & (alpha < c)) | ((sign < 0) & (alpha > 0))
    low = ((sign > 0) & (alpha > 0)) | ((sign < 0) & (alpha < c))
    bias = float(score[free].mean()) if free.any() else float((np.where(up, score, -np.inf).max() + np.where(low, score, np.inf).min()) / 2)
    return {"coef": x.T @ beta, "intercept": bias}


def fit_knn(x: np.ndarray, y: np.ndarray, k: int = 5, weights: str = "uniform") -> dict:
    if len(x) < k:
        raise ValueError(f"{k} neighbours of {len(x)} rows")
    return {"x": x, "y": y, "k": k, "weights": weights}


def fit_tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, share: float = 1.0, least: int = 1, depth: int = 64) -> dict:
    """Splits of the largest fall of the squared error, the nodes of a level at once; columns are sorted once."""
    n, p = x.shape
    feature, at, left, right, value, gain = [], [], [], [], [], np.zeros(p)
    # The rows of the open nodes, node after node, in the order of each column; bounds of the nodes.
    order = [np.argsort(x[:, f], kind="stable") for f in range(p)]
    rows, size, made = np.arange(n), np.array([n]), 1
    for level in range(depth + 1):
        first = np.cumsum(size) - size
        mean = np.add.reduceat(y[rows], first) / size
        low, high = np.minimum.reduceat(y[rows], first), np.maximum.reduceat(y[rows], first)
        value.append(np.where(low == high, low, mean))
        of = np.repeat(np.arange(len(size)), size)
        best, by, cut = np.full(len(size), 1e-12), np.full(len(size), -1), np.zeros(len(size))
        open_ = (size >= 2 * least) & (high > low) & (level < depth)
        if open_.any():
            tried = np.ones((len(size), p), bool)
            if share < 1:
                tried[:] = False
                for k in range(len(size)):
                    tried[k, rng.choice(p, max(1, round(share * p)), replace=False)] = True
            i = np.arange(len(rows)) - first[of] + 1
            rest = size[of] - i
            inside = (open_[of]) & (i >= least) & (rest >= max(least, 1))
            weight = size[of] / (i * np.maximum(rest, 1))
            for f in range(p):
                o = order[f]
                v = x[o, f]
                good = inside & tried[of, f]
                good[:-1] &= v[1:] > v[:-1]
                good[-1] = False
                better = np.where(good, np.cumsum(y[o] - mean[of]) ** 2 * weight, -np.inf)
                most = np.maximum.reduceat(better, first)
                if (more := most > best).any():
                    where = np.flatnonzero((better == most[of]) & more[of])
                    k, place = np.unique(of[where], return_index=True)
                    where = where[place]
                    middle = (v[where] + v[where + 1]) / 2
                    best[k], by[k], cut[k] = most[k], f, np.where(middle < v[where + 1], middle, v[where])
        split = by >= 0
        np.add.at(gain, by[split], best[split])
        feature.append(by)
        at.append(cut)
        children = made + 2 * np.cumsum(split) - 2
        left.append(np.where(split, children, -1))
        right.append(np.where(split, children + 1, -1))
        made += 2 * int(split.sum())
        if not split.any():
            break
        goes = np.zeros(n, bool)
        own = split[of]
        goes[rows[own]] = x[rows[own], by[of[own]]] <= cut[of[own]]
        # The same rows of open nodes again, those that go left before those that go right.
        size = size[split]
        first, of = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)

        def dealt(o: np.ndarray) -> np.ndarray:
            o = o[own]
            is_left = goes[o]
            before = np.cumsum(is_left) - is_left
            before = before - before[first][of]
            n_left = np.add.reduceat(is_left.astype(np.int64), first)
            within = np.arange(len(o)) - first[of]
            out = np.empty_like(o)
            out[first[of] + np.where(is_left, before, n_left[of] + within - before)] = o
            return out

        n_left = np.add.reduceat(goes[rows[own]].astype(np.int64), first)
        order = [dealt(o) for o in order]
        rows = dealt(rows)
        size = np.stack([n_left, size - n_left], 1).ravel()
    small = lambda some: np.concatenate(some).astype(np.int32)  # noqa: E731  a forest holds twice as many nodes a tree as rows
    return {"feature": small(feature), "at": np.concatenate(at), "left": small(left), "right": small(right), "value": np.concatenate(value), "gain": gain}


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 100, seed: int = 42, share: float = 1.0, least: int = 1) -> dict:
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        rows = rng.integers(len(x), size=len(x))
        out.append(fit_tree(x[rows], y[rows], rng, share, least))
    gain = sum(t["gain"] / max(t["gain"].sum(), 1e-300) for t in out) / trees
    return {"trees": out, "importance": gain}


#: Numbers of a block of distances.
BLOCK = 1 << 20


def nearest(known: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of the k known rows nearest to each row of x, the first of equally near ones first.

    A block of rows of x, neighbours along the column that varies most, meets the known rows within its reach on that
    column: the distance of the k-th of some known rows is no less than that of the k-th of all.
    """
    # Of equal known rows no more than the first k can be among the nearest.
    _, same = np.unique(known, axis=0, return_inverse=True)
    order = np.argsort(same := same.ravel(), kind="stable")
    n = np.bincount(same)
    few = np.sort(order[np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n) < k])
    wide = int(known[few].std(0).argmax())
    few = few[np.argsort(known[few, wide], kind="stable")]
    part = known[few]
    line = np.ascontiguousarray(part[:, wide])
    index, distance = np.empty((len(x), k), np.int64), np.empty((len(x), k))

    def apart(q: np.ndarray, a: int, b: int) -> np.ndarray:
        total = np.zeros((len(q), b - a))
        for j in range(q.shape[1]):
            d = q[:, j, None] - part[None, a:b, j]
            d *= d
            total += d
        return np.nan_to_num(np.sqrt(total, out=total), copy=False, nan=np.inf, posinf=np.inf)

    along = np.argsort(x[:, wide], kind="stable")
    at = 0
    while at < len(x):
        some = along[at : at + 128]
        q = x[some]
        lo, hi = q[0, wide], q[-1, wide]
        a, b = (int(np.searchsorted(line, v, side)) for v, side in ((lo, "left"), (hi, "right")))
        a, b = max(0, a - 4 * k), min(len(few), b + 4 * k)
        if (b - a) * len(some) > BLOCK:
            middle = (a + b) // 2
            a, b = middle - BLOCK // len(some) // 2, middle + BLOCK // len(some) // 2
        if b - a < k:
            a, b = 0, len(few)
        reach = float(np.partition(apart(q, a, b), k - 1, axis=1)[:, k - 1].max()) * (1 + 1e-9)
        a, b = (int(np.searchsorted(line, lo - reach, "left")), int(np.searchsorted(line, hi + reach, "right"))) if np.isfinite(reach) else (0, len(few))
        # As many rows as fit a block, one at least; their reach is no more than that of all.
        some = some[: max(1, BLOCK // (b - a))]
        d = apart(x[some], a, b)
        row, column = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1, None])
        far, own = d[row, column], few[a:b][column]
        by = np.lexsort((own, far, row))
        row = row[by]
        top = by[(np.arange(len(row)) - np.searchsorted(row, np.arange(len(some)))[row]) < k]
        index[some], distance[some] = own[top].reshape(-1, k), far[top].reshape(-1, k)
        at += len(some)
    return index, distance


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if "coef" in model:
        return x @ np.asarray(model["coef"], float) + model["intercept"]
    # Equal rows have equal predictions.
    x, place = np.unique(x, axis=0, return_inverse=True)
    return _predict(model, x)[place.ravel()]


def _predict(model: dict, x: np.ndarray) -> np.ndarray:
    if "trees" in model:
        total = np.zeros(len(x))
        for t in model["trees"]:
            node, live = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(live := live[t["feature"][node[live]] >= 0]):
                own = node[live]
                go = x[live, t["feature"][own]] <= t["at"][own]
                node[live] = np.where(go, t["left"][own], t["right"][own])
            total += t["value"][node]
        return total / len(model["trees"])
    y = np.asarray(model["y"], float)
    near, far = nearest(np.asarray(model["x"], float), x, int(model["k"]))
    if model["weights"] == "distance":
        with np.errstate(divide="ignore"):
            w = 1 / far
        exact = np.isinf(w).any(1)
        w[exact] = np.isinf(w[exact])
        return (y[near] * w).sum(1) / w.sum(1)
    return y[near].mean(1)


def fit(kind: str, x: np.ndarray, y: np.ndarray, **settings) -> dict:
    fits: dict[str, Callable] = {"linear": fit_linear, "elasticnet": fit_elasticnet, "svm": fit_svm, "knn": fit_knn, "randomforest": fit_forest}
    if kind not in fits:
        raise ValueError(f"{kind} is none of {', '.join(fits)}")
    if np.isnan(x).any() or np.isnan(y).any():
        raise ValueError("missing values")
    return fits[kind](np.asarray(x, float), np.asarray(y, float), **settings)


def min_max(train: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    low, width = train.min(0), np.ptp(train, axis=0)
    return [np.where(width > 0, (x - low) / np.where(width > 0, width, 1), 0.0) for x in (train, *others)]


def low_variance(x: np.ndarray, least: float = 0.01) -> np.ndarray:
    """Columns that vary after scaling; the first one if none does."""
    z = min_max(x)[0]
    keep = np.flatnonzero(z.std(0) / (np.abs(z.mean(0)) + 1e-8) >= least)
    return keep if len(keep) else np.arange(min(1, x.shape[1]))


def prune(x: np.ndarray, y: np.ndarray, names: list[str], threshold: float = 0.9) -> list[int]:
    from descra.operators.stats import prune_pairs

    r = [ranks(x[:, k]) for k in range(x.shape[1])]
    correlation = lambda a, b: None if np.ptp(a) == 0 or np.ptp(b) == 0 else float(np.corrcoef(a, b)[0, 1])
    pairs = [(names[i], names[j], correlation(r[i], r[j])) for i in range(len(names)) for j in range(i + 1, len(names))]
    ry = ranks(y)
    kept = set(prune_pairs(pairs, {n: correlation(r[i], ry) for i, n in enumerate(names)}, threshold))
    return [i for i, n in enumerate(names) if n in kept]


Fold = tuple[np.ndarray, np.ndarray]


def fold_score(kind: str, x: np.ndarray, y: np.ndarray, columns: list[int], folds: list[Fold], **settings) -> float:
    """Mean rank correlation over folds, scaled within each; folds that cannot be scored are left out."""
    out = []
    for train, test in folds:
        try:
            a, b = min_max(x[train][:, columns], x[test][:, columns])
            s = scores(y[test], predict(fit(kind, a, y[train], **settings), b))["spearman"]
        except ValueError:
            continue
        out.append(-math.inf if s is None else s)
    return float(np.mean(out)) if out else -math.inf


def forward(kind: str, x: np.ndarray, y: np.ndarray, folds: list[Fold], most: int, gain: float = 0.02, floating: bool = False, **settings) -> list[int]:
    """Columns added one by one while the best addition gains enough (the first of equals); floating also takes out again."""
    chosen: list[int] = []
    score = -math.inf
    while len(chosen) < most:
        options = [(fold_score(kind, x, y, [*chosen, j], folds, **settings), j) for j in range(x.shape[1]) if j not in chosen]
        best = max(options, key=lambda o: o[0], default=None)
        if best is None or best[0] == -math.inf or (chosen and best[0] - score < gain):
            break
        chosen, score = [*chosen, best[1]], best[0]
        while floating and len(chosen) > 2:
            fewer = [(fold_score(kind, x, y, [c for c in chosen if c != j], folds, **settings), j) for j in chosen[:-1]]
            s, j = max(fewer, key=lambda o: o[0])
            if s - score < gain:
                break
            chosen, score = [c for c in chosen if c != j], s
    return chosen or ([0] if x.shape[1] else [])


def eliminate(x: np.ndarray, y: np.ndarray, keep: int, kind: str = "linear", **settings) -> list[int]:
    """Columns left when the one with the least weight goes, again and again."""
    left = list(range(x.shape[1]))
    while len(left) > keep:
        m = fit(kind, min_max(x[:, left])[0], y, **settings)
        weight = np.abs(m["coef"]) if "coef" in m else m["importance"]
        left.pop(int(weight.argmin()))
    return left


def stability(x: np.ndarray, y: np.ndarray, n: int | None = None, share: float | None = None, seed: int = 42, alpha: float = 0.1, l1_ratio: float = 0.5) -> np.ndarray:
    """How often each column has weight in fits on random parts of the rows."""
    rows = len(x)
    n = n or int(max(100, min(300, round(500 / math.log10(max(rows, 2))))))
    share = share or max(0.4, min(0.8, 1 / math.log10(5 + rows)))
    rng, hits = np.random.default_rng(seed), np.zeros(x.shape[1])
    z = min_max(x)[0]
    for _ in range(n):
        some = rng.choice(rows, max(2, int(share * rows)), replace=False)
        hits += np.abs(fit_elasticnet(z[some], y[some], alpha, l1_ratio)["scaled_coef"]) > 1e-8
    return hits / n


def most_stable(x: np.ndarray, y: np.ndarray, n: int, draws: int = 50) -> list[int]:
    """The n columns that subsamples choose most often, most first; the earlier column in a tie."""
    return np.argsort(-stability(x, y, draws), kind="stable")[: max(1, min(n, x.shape[1]))].tolist()


def strongest(kind: str, x: np.ndarray, y: np.ndarray, most: int, **settings) -> list[int]:
    """The columns, at most ``most`` and in their order, that weigh most in a probe of this kind.

    A model without weights (nearest neighbours, a kernel) is probed by an elastic net.
    """
    if x.shape[1] <= most:
        return list(range(x.shape[1]))
    model = fit(kind, x, y, **settings)
    weight = model.get("coef", model.get("importance"))
    if weight is None or len(weight) != x.shape[1]:
        weight = fit("elasticnet", x, y, alpha=0.01, l1_ratio=0.5)["coef"]
    return sorted(np.argsort(-np.abs(np.asarray(weight, float)), kind="stable")[:most].tolist())


def permutation_importance(model: dict, x: np.ndarray, y: np.ndarray, repeats: int = 10, seed: int = 42) -> np.ndarray:
    """Mean rise of the squared error when a column is shuffled."""
    rng, base = np.random.default_rng(seed), ((y - predict(model, x)) ** 2).mean()
    out = np.zeros(x.shape[1])
    for j in range(x.shape[1]):
        for _ in range(repeats):
            z = x.copy()
            z[:, j] = rng.permutation(z[:, j])
            out[j] += ((y - predict(model, z)) ** 2).mean() - base
    return out / repeats
