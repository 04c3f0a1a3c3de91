"""Moments, Mahalanobis scores and logistic fits from fixed-size sums over an array column.

Each task reduces its rows to one row of sums (a mean and a d x d matrix, or a gradient and a Hessian). These rows are merged in
``FAN`` groups and then on the driver, so what leaves the executors grows with d, never with the data.

A component that is NULL, NaN or infinite is missing. A vector that is NULL, of another length or has a missing component takes no
part in moments and its scores are NULL. For fits, ``complete`` gives missing values a defined value and an indicator first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

FAN = 64
BATCH = 4096  # rows of a matrix at a time
_PART = "part int, sums binary"

State = tuple[np.ndarray, ...]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows x ``width`` doubles of a list column; a list that is NULL or of another length is a row of NaN, like a NULL component."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    good = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    out = np.full((len(column), width), np.nan)
    flat = column.filter(good).flatten().cast(pa.float64())
    out[good.to_numpy(zero_copy_only=False)] = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
    out[~np.isfinite(out)] = np.nan
    return out


def pack(state: State) -> bytes:
    return b"".join(np.ascontiguousarray(a, np.float64).tobytes() for a in state)


def unpack(raw: bytes, like: State) -> State:
    flat, out, at = np.frombuffer(raw, np.float64), [], 0
    for a in like:
        out.append(flat[at:at + a.size].reshape(a.shape).copy())
        at += a.size
    return tuple(out)


def reduce_rows(rows: DataFrame, zero: State, step: Callable[[State, pa.RecordBatch], State], merge: Callable[[State, State], State]) -> State:
    """``step`` folds the batches of a task into a state of fixed size, ``merge`` joins two states; returns the whole table's."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        state = zero
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                state = step(state, b.slice(at, BATCH))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pack(state)], pa.binary())], ["part", "sums"])

    def group(table: pa.Table) -> pa.Table:
        table, state = table.sort_by("part"), zero
        for raw in table.column("sums").to_pylist():
            state = merge(state, unpack(raw, zero))
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "sums": pa.array([pack(state)], pa.binary())})

    parts = rows.mapInArrow(task, _PART).groupBy((F.col("part") % FAN).alias("g")).applyInArrow(group, _PART)
    state = zero
    for r in sorted(parts.collect(), key=lambda r: r["part"]):  # at most FAN rows
        state = merge(state, unpack(bytes(r["sums"]), zero))
    return state


def add(a: State, b: State) -> State:
    return tuple(x + y for x, y in zip(a, b))


def pool(a: State, b: State) -> State:
    """Counts, means and centred sums of two sets, for their union: no difference of large sums."""
    n = a[0] + b[0]
    if not n[0]:
        return a
    d, share = b[1] - a[1], b[0] / n
    spread = np.outer(d, d) if a[2].ndim == 2 else d * d
    return n, a[1] + d * share, a[2] + b[2] + spread * (a[0] * share)


def width_of(rows: DataFrame, vector: str) -> int:
    """The greatest length of a vector; 0 without any."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def moments(rows: DataFrame, vector: str, width: int, full: bool = True) -> State:
    """``n``, mean and centred sums of products (of squares alone unless ``full``) over complete vectors."""
    def step(state: State, b: pa.RecordBatch) -> State:
        x = matrix(b.column("x"), width)
        x = x[~np.isnan(x).any(axis=1)]
        if not len(x):
            return state
        m = x.mean(axis=0)
        x = x - m
        return pool(state, (np.array([float(len(x))]), m, x.T @ x if full else (x * x).sum(axis=0)))

    zero = np.zeros(1), np.zeros(width), np.zeros((width, width) if full else width)
    return reduce_rows(rows.select(F.col(vector).alias("x")), zero, step, pool)


def distances(vector: str, mean: np.ndarray, low: np.ndarray, scale: float = 1.0) -> Column:
    """``scale * |L^T (x - mean)|`` of each vector, NULL for an incomplete one; ``low`` may be a vector (a diagonal)."""
    width = len(mean)

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(column), BATCH):
            x = matrix(column.slice(at, BATCH), width) - mean
            y = x * low if low.ndim == 1 else x @ low
            out.append(np.sqrt((y * y).sum(axis=1)) * scale)
        d = np.concatenate(out) if out else np.zeros(0)
        return pa.array(d, pa.float64(), mask=np.isnan(d))

    return run(F.col(vector))


def vector_diag_mahalanobis(rows: DataFrame, vector: str, train: Column, floor: float = 1e-4, limit: float = 3.5) -> DataFrame:
    """Adds ``ood_score``, the root mean squared z-score over all components under the moments of ``train`` rows, and ``is_ood``.

    Both are NULL for incomplete vectors, and for all rows where fewer than two training vectors are complete.
    """
    fit = rows.filter(train)
    width = width_of(fit, vector)
    n, mean, squares = moments(fit, vector, width, full=False)
    score = F.lit(None).cast("double")
    if n[0] > 1 and width:
        score = distances(vector, mean, 1.0 / np.sqrt(np.maximum(squares / (n[0] - 1), floor)), 1.0 / np.sqrt(width))
    return rows.withColumn("ood_score", score).withColumn("is_ood", F.col("ood_score") > limit)


def vector_full_mahalanobis(rows: DataFrame, vector: str, train: Column, ridge: float = 1e-3) -> DataFrame:
    """Adds ``distance`` under the ridge covariance of ``train`` rows, ``epistemic`` (share of the 99 % limit, at most 1) and ``ood_level``.

    The limits are exact quantiles of the training distances. Incomplete vectors have NULL in all three, and so has every row where
    fewer than two training vectors are complete.
    """
    from packetloom.functions.columns import choose
    from packetloom.functions.quantiles import group_quantiles
    fit = rows.filter(train)
    width = width_of(fit, vector)
    n, mean, products = moments(fit, vector, width)
    if n[0] < 2 or not width:
        return rows.withColumns({"distance": F.lit(None).cast("double"), "epistemic": F.lit(None).cast("double"), "ood_level": F.lit(None).cast("string")})
    low = np.linalg.cholesky(np.linalg.inv(products / (n[0] - 1) + ridge * np.eye(width)))
    x = rows.withColumn("distance", distances(vector, mean, low))
    one = x.filter(train).filter("distance IS NOT NULL").select(F.lit(0).alias("_k"), "distance")
    lim = group_quantiles(one, ["_k"], "distance", {"p95": 0.95, "p99": 0.99}).first()
    p95, p99, d = F.lit(lim["p95"]), F.lit(lim["p99"]), F.col("distance")
    return x.withColumns({"epistemic": F.when(d.isNotNull(), F.when(p99 > 0, F.least(F.lit(1.0), d / p99)).otherwise((d > 0).cast("double"))),
                          "ood_level": F.when(d.isNotNull(), choose((d > p99, "OUT"), (d > p95, "BORDER"), default="IN"))})


# --- logistic fits ------------------------------------------------------------------------------------
@dataclass
class Logistic:
    """Weights for standardised columns (values, then an indicator of a missing value for each) and what standardises them."""

    columns: Sequence[str]
    mean: np.ndarray
    scale: np.ndarray  # 0 for a constant column: it has no part in the model
    weights: np.ndarray
    intercept: float
    steps: int = 0
    converged: bool = True
    fill: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self) -> Column:
        """The linear score as one column expression."""
        value = complete(self.columns, self.fill)
        terms = [(value[i] - F.lit(float(self.mean[i]))) * F.lit(float(self.weights[i] * self.scale[i]))
                 for i in range(len(self.mean)) if self.weights[i] and self.scale[i]]
        return sum(terms, F.lit(float(self.intercept)))

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.margin()))


def usable(name: str) -> Column:
    v = F.col(name).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def complete(columns: Sequence[str], fill: Sequence[float]) -> list[Column]:
    """Each column with ``fill`` for missing values, then an indicator of 1.0 for each column where it is missing."""
    return [F.coalesce(usable(n), F.lit(float(v))) for n, v in zip(columns, fill)] + [usable(n).isNull().cast("double") for n in columns]


def newton_logistic(train: DataFrame, columns: Sequence[str], label: str, l2: float = 1e-3, balanced: bool = True, steps: int = 50,
                    tolerance: float = 1e-10) -> Logistic | None:
    """``newton_logistics`` for one label."""
    return newton_logistics(train, columns, [label], l2, balanced, steps, tolerance)[0]


def newton_logistics(train: DataFrame, columns: Sequence[str], labels: Sequence[str], l2: float = 1e-3, balanced: bool = True, steps: int = 50,
                     tolerance: float = 1e-10) -> list[Logistic | None]:
    """Logistic regression on each label by Newton steps with halving; None for a label that has only one class.

    Each minimises the weighted mean of the log loss plus ``l2 / 2`` times the squared weights of the standardised columns (the intercept is
    free). ``balanced`` gives both classes half of the weight. One pass over the rows serves the next step of all labels. A row takes no part
    in the fit of a label that it has as NULL, and none at all without any label; a missing value counts as the mean of its column and sets
    its indicator. On classes that the columns separate, without ``l2``, the steps end after ``steps`` passes with ``converged`` False.
    """
    columns, labels = list(columns), list(labels)
    d, many = 2 * len(columns), len(labels)
    t = train.filter(F.coalesce(*labels).isNotNull())
    first = t.agg(*[F.avg(usable(n)).alias(f"m{i}") for i, n in enumerate(columns)], *[F.count(n).alias(f"n{i}") for i, n in enumerate(labels)],
                  *[F.sum(F.col(n).cast("double")).alias(f"p{i}") for i, n in enumerate(labels)]).first()
    count, pos = (np.array([first[f"{k}{i}"] or 0 for i in range(many)], float) for k in "np")
    open_ = [i for i in range(many) if 0 < pos[i] < count[i]]
    if not open_:
        return [None] * many
    fill = np.array([first[f"m{i}"] or 0.0 for i in range(len(columns))])
    rows = t.select(F.array(*complete(columns, fill)).alias("x"), F.array(*[F.col(n).cast("double") for n in labels]).alias("y"))
    n, mean, squares = moments(rows, "x", d, full=False)
    spread = np.sqrt(squares / max(n[0] - 1, 1))
    scale = np.divide(1.0, spread, out=np.zeros(d), where=spread > 1e-12 * np.maximum(1.0, np.abs(mean)))
    on = np.flatnonzero(scale)
    k = len(on) + 1
    pen = np.r_[0.0, np.full(k - 1, l2)]
    share = 2.0 if balanced else 1.0  # of the weight that a row of each class carries
    up, down = (np.divide(1.0, c if balanced else count, out=np.zeros(many), where=c > 0) / share for c in (pos, count - pos))

    def sums(beta: dict[int, np.ndarray]) -> State:
        """Loss, gradient and Hessian of each label at its ``beta`` (intercept first)."""
        def step(state: State, b: pa.RecordBatch) -> State:
            x = (matrix(b.column("x"), d)[:, on] - mean[on]) * scale[on]
            x, ys = np.column_stack([np.ones(len(x)), x]), matrix(b.column("y"), many)
            loss, grad, hess = (a.copy() for a in state)
            for i, at in beta.items():
                y = np.nan_to_num(ys[:, i])
                w = np.where(np.isnan(ys[:, i]), 0.0, np.where(y > 0, up[i], down[i]))
                z = x @ at
                q = np.exp(-np.logaddexp(0.0, -z))
                loss[i] += (w * (np.logaddexp(0.0, z) - y * z)).sum()
                grad[i] += x.T @ (w * (q - y))
                hess[i] += (x * (w * q * (1 - q))[:, None]).T @ x
            return loss, grad, hess

        loss, grad, hess = reduce_rows(rows, (np.zeros(many), np.zeros((many, k)), np.zeros((many, k, k))), step, add)
        for i, at in beta.items():
            loss[i] += (pen * at * at).sum() / 2
            grad[i] += pen * at
            hess[i] += np.diag(pen)
        return loss, grad, hess

    beta, size, taken, left = {i: np.zeros(k) for i in open_}, dict.fromkeys(open_, 1.0), dict.fromkeys(open_, 0), list(open_)
    loss, grad, hess = sums(beta)
    for _ in range(steps):
        move = {i: size[i] * np.linalg.lstsq(hess[i], grad[i], rcond=1e-12)[0] for i in left}  # columns that are copies share their weight
        trial = {i: beta[i] - move[i] for i in left}
        new = sums(trial)
        for i in list(left):
            if new[0][i] > loss[i] + 1e-15 and size[i] > 1e-6:
                size[i] /= 2
                continue
            beta[i], size[i], taken[i] = trial[i], 1.0, taken[i] + 1
            loss[i], grad[i], hess[i] = (a[i] for a in new)
            if np.abs(move[i]).max() < tolerance:
                left.remove(i)
        if not left:
            break
    out: list[Logistic | None] = [None] * many
    for i in open_:
        weights = np.zeros(d)
        weights[on] = beta[i][1:]
        out[i] = Logistic(columns, mean, scale, weights, float(beta[i][0]), taken[i], i not in left, fill)
    return out
