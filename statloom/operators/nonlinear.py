"""Bounded, weighted Levenberg-Marquardt least squares, one fit per group.

:func:`nonlinear_least_squares` takes a numpy model and runs each group's points in
one task, up to GROUP_ROWS of them; larger groups take steps by aggregates too, to which
each task adds sums of its rows. :func:`distributed_least_squares` takes
a model of columns, for groups of any size: a step is one aggregate over the data
(the squared residuals, J'WJ and J'Wr, with the Jacobian as expressions), of which
only these few numbers per group reach the driver, where the step is solved. All
groups step together; those that have converged drop out of the aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArraySizeError, InvalidArgumentError, InvalidInputError, ToleranceTooSmallError, TooFewIterationsError, UnderdefinedProblemError
from ..functions import kernel as K
from ..workers import importable

LEVENBERG_MARQUARDT_UPDATE, QUADRATIC_UPDATE, NIELSEN_UPDATE = 1, 2, 3


@dataclass(frozen=True)
class IterationControls:
    max_iteration_count: int = 500
    max_function_evaluations: int = 5000
    max_iteration_between_updates: int = 10
    gradient_tolerance: float = 1e-8
    residual_tolerance: float = 0.5e-2
    change_in_solution_tolerance: float = 1e-6
    iteration_improvement_tolerance: float = 0.1


@dataclass(frozen=True)
class SolverOptions:
    method: int = LEVENBERG_MARQUARDT_UPDATE
    finite_difference_step_size: float = float(np.sqrt(np.finfo(float).eps))
    damping_increase_factor: float = 11.0
    damping_decrease_factor: float = 9.0


@dataclass
class Fit:
    params: np.ndarray
    modelled: np.ndarray
    residuals: np.ndarray
    covariance: np.ndarray
    iterations: int = 0
    evaluations: int = 0
    chi_squared: float = 0.0
    converged_on: set[str] = field(default_factory=set)
    stopped_by: str = ""


Model = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _check(x, y, p, w, lo, hi, c: IterationControls) -> None:
    if len(x) != len(y) or (w is not None and len(w) != len(y)) or (lo is not None and len(lo) != len(p)) or (hi is not None and len(hi) != len(p)):
        raise ArraySizeError("arrays of other sizes than expected")
    if len(y) < len(p):
        raise UnderdefinedProblemError("fewer points than parameters")
    _check_controls(c)


def _check_controls(c: IterationControls) -> None:
    if min(c.gradient_tolerance, c.residual_tolerance, c.change_in_solution_tolerance, c.iteration_improvement_tolerance) < 1e-14:
        raise ToleranceTooSmallError("tolerances are at least 1e-14")
    if c.max_iteration_count < 2 or c.max_function_evaluations < 10 or c.max_iteration_between_updates < 1:
        raise TooFewIterationsError("at least 2 iterations, 10 evaluations and 1 iteration between updates")


def fit(model: Model, x, y, params, weights=None, lower=None, upper=None, controls: IterationControls | None = None, options: SolverOptions | None = None, update: Callable[[int, np.ndarray], bool] | None = None) -> Fit:
    """Minimises sum w (y - model(x, p))^2 with p inside its bounds. ``update`` may return True to stop."""
    c, o = controls or IterationControls(), options or SolverOptions()
    x, y, p = np.asarray(x, float), np.asarray(y, float), np.array(params, float)
    _check(x, y, p, weights, lower, upper, c)
    if o.method not in (1, 2, 3):
        raise InvalidInputError("an unknown update method")
    w = np.ones(len(y)) if weights is None else np.asarray(weights, float)
    lo = np.full(len(p), -np.inf) if lower is None else np.asarray(lower, float)
    hi = np.full(len(p), np.inf) if upper is None else np.asarray(upper, float)
    p = np.clip(p, lo, hi)
    calls = 0

    def run(q: np.ndarray) -> np.ndarray:
        nonlocal calls
        calls += 1
        return np.asarray(model(x, q), float)

    def differences(q: np.ndarray, f: np.ndarray) -> np.ndarray:
        out = np.empty((len(y), len(q)))
        for i in range(len(q)):
            z = q.copy()
            z[i] += o.finite_difference_step_size
            out[:, i] = (run(z) - f) / o.finite_difference_step_size
        return out

    f = run(p)
    r = y - f
    chi = float(w @ (r * r))
    jac = differences(p, f)
    h, g = jac.T @ (w[:, None] * jac), jac.T @ (w * r)
    lam = 1e-2 if o.method == 1 else 1e-2 * float(np.diag(h).max())
    nu, age, it, dof = 2.0, 0, 0, max(1, len(y) - len(p))
    result = Fit(p, f, r, h)
    while not result.converged_on and not result.stopped_by:
        it += 1
        d = np.diag(np.diag(h)) if o.method == 1 else np.eye(len(p))
        try:
            step = np.linalg.solve(h + lam * d, g)
        except np.linalg.LinAlgError:
            step = np.linalg.lstsq(h + lam * d, g, rcond=None)[0]
        trial = np.clip(p + step, lo, hi)
        f1 = run(trial)
        chi1 = float(w @ (y - f1) ** 2)
        alpha = 1.0
        if o.method == 2:
            gh = float(g @ step)
            alpha = abs(gh / (0.5 * (chi1 - chi) + 2 * gh)) if 0.5 * (chi1 - chi) + 2 * gh else 1.0
            step = alpha * step
            trial = np.clip(p + step, lo, hi)
            f1 = run(trial)
            chi1 = float(w @ (y - f1) ** 2)
        gain = abs(float(step @ (lam * (d @ step) + g)))
        rho = (chi - chi1) / gain if gain else (1.0 if chi1 <= chi else -1.0)
        accepted = np.isfinite(chi1) and rho > c.iteration_improvement_tolerance
        worse = chi1 > chi
        if accepted:
            move, f0 = trial - p, f
            p, f, r = trial, f1, y - f1
            chi = chi1
            age += 1
            if age >= c.max_iteration_between_updates or worse:
                jac, age = differences(p, f), 0
            elif move @ move > 0:  # Broyden's rank-one update
                jac = jac + np.outer((f - f0 - jac @ move) / (move @ move), move)
            h, g = jac.T @ (w[:, None] * jac), jac.T @ (w * r)
            if o.method == 1:
                lam = max(lam / o.damping_decrease_factor, 1e-7)
            elif o.method == 2:
                lam = max(lam / (1 + alpha), 1e-7)
            else:
                lam, nu = lam * max(1 / 3, 1 - (2 * rho - 1) ** 3), 2.0
        else:
            if age:  # a rejected step may be the fault of an old Jacobian
                jac, age = differences(p, f), 0
                h, g = jac.T @ (w[:, None] * jac), jac.T @ (w * r)
            if o.method == 1:
                lam = min(lam * o.damping_increase_factor, 1e7)
            elif o.method == 2:
                lam = lam + abs((chi1 - chi) / 2 / alpha) if alpha and np.isfinite(chi1) else lam * o.damping_increase_factor
            else:
                lam, nu = lam * nu, nu * 2
        if it > 2:
            if np.abs(g).max() < c.gradient_tolerance:
                result.converged_on.add("gradient")
            if np.max(np.abs(step) / (np.abs(p) + 1e-12)) < c.change_in_solution_tolerance:
                result.converged_on.add("change")
            if chi / dof < c.residual_tolerance:
                result.converged_on.add("residual")
        if it >= c.max_iteration_count:
            result.stopped_by = "iterations"
        elif calls >= c.max_function_evaluations:
            result.stopped_by = "evaluations"
        elif update is not None and update(it, p):
            result.stopped_by = "user"
    jac = differences(p, f)
    result.params, result.modelled, result.residuals, result.iterations, result.evaluations, result.chi_squared = p, f, r, it, calls, chi
    result.covariance = np.linalg.pinv(jac.T @ (w[:, None] * jac), rcond=1e-14)
    return result


def statistics(f: Fit, alpha: float = 0.05) -> list[dict[str, float]]:
    """Per parameter: standard error, t statistic, probability and half of the confidence interval. The variance is of the unweighted residuals."""
    return _coefficients(f.params, f.covariance, len(f.residuals), float(f.residuals @ f.residuals), alpha)


def _coefficients(params: np.ndarray, covariance: np.ndarray, n: int, squares: float, alpha: float) -> list[dict[str, float]]:
    dof = n - len(params)
    s2 = squares / dof if dof else np.nan
    q = K.t_quantile(1 - alpha / 2, dof) if dof else np.nan
    out = []
    for i in range(len(params)):
        se = float(np.sqrt(s2 * covariance[i, i]))
        t = float(params[i] / se) if se else np.nan
        out.append({"standard_error": se, "t_statistic": t, "probability": K.two_sided_t(t, float(dof)) if np.isfinite(t) else np.nan, "confidence_interval": q * se})
    return out


def nonlinear_least_squares(df: DataFrame, model: Model, x: str, y: str, params: Sequence[float], weight: str | None = None, by: Sequence[str] = (), lower: Sequence[float] | None = None, upper: Sequence[float] | None = None, controls: IterationControls | None = None, options: SolverOptions | None = None, alpha: float = 0.05, group_rows: int | None = None) -> DataFrame:
    """A fit per group: by, parameter, estimate, standard_error, t_statistic, probability, confidence_interval, iterations, converged.

    Rows with a null are left out. The points of a group of up to ``group_rows`` rows
    (GROUP_ROWS) run in one task; fits of many groups run side by side. Larger groups are
    never in one task: see :func:`_large`. Their passes read ``df`` again.
    """
    by = list(by)
    cols = [F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w")]
    rows = df.select(*by, *cols).dropna(subset=["__x", "__y", "__w"])
    names = ["parameter", "estimate", "standard_error", "t_statistic", "probability", "confidence_interval", "iterations", "converged"]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__x", "__y"], kind="stable")
        got = fit(model, part["__x"].to_numpy(), part["__y"].to_numpy(), params, part["__w"].to_numpy(), lower, upper, controls, options)
        keys = part[by].iloc[0].tolist() if by else []
        return pd.DataFrame([[*keys, i, float(p), *s.values(), got.iterations, bool(got.converged_on)] for i, (p, s) in enumerate(zip(got.params, statistics(got, alpha), strict=True))], columns=[*by, *names])

    kinds = [T.IntegerType(), *[T.DoubleType()] * 5, T.IntegerType(), T.BooleanType()]
    schema = T.StructType([*[rows.schema[b] for b in by], *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    most = GROUP_ROWS if group_rows is None else group_rows
    large = [tuple(r)[:-1] for r in rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).collect()]
    if not large:
        return importable(rows).groupBy(*by).applyInPandas(one, schema)
    keys = rows.sparkSession.createDataFrame([(*key, i) for i, key in enumerate(large)], _keyed(rows, by))
    on = [F.col(b).eqNullSafe(F.col(f"__by{i}")) for i, b in enumerate(by)]
    found = _large(rows.join(F.broadcast(keys), on) if by else rows.crossJoin(keys), model, large, params, lower, upper, controls, options)
    out = []
    for key, f in zip(large, found, strict=True):
        stats = _coefficients(f.at.p, np.linalg.pinv(f.at.h, rcond=1e-14, hermitian=True), f.at.n, f.at.squares, alpha)
        out += [(*key, i, float(f.at.p[i]), *map(float, s.values()), f.iterations, bool(f.converged_on)) for i, s in enumerate(stats)]
    fits = rows.sparkSession.createDataFrame(out, schema)
    return fits.unionByName(importable(rows.join(F.broadcast(keys), on, "left_anti")).groupBy(*by).applyInPandas(one, schema)) if by else fits


#: Points of a group that one task fits: some hundreds of MB with their Jacobian.
GROUP_ROWS = 1 << 20
#: Points whose sums a task makes at once.
SUM_ROWS = 1 << 16


def _keyed(rows: DataFrame, by: list[str]) -> T.StructType:
    return T.StructType([*[T.StructField(f"__by{i}", rows.schema[b].dataType) for i, b in enumerate(by)], T.StructField("__k", T.IntegerType())])


def _sums(model: Model, q: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """n, weighted and plain squares, J'WJ and J'Wr of some points: those of a group add up."""
    step = CENTRAL_STEP * np.maximum(np.abs(q), 1.0)
    j = np.empty((len(x), len(q)))
    for i, e in enumerate(np.diag(step)):
        j[:, i] = (np.asarray(model(x, q + e), float) - np.asarray(model(x, q - e), float)) / (2 * step[i])
    r = y - np.asarray(model(x, q), float)
    return np.concatenate([[len(x), w @ (r * r), r @ r], (j.T @ (w[:, None] * j)).ravel(), j.T @ (w * r)])


def _large(rows: DataFrame, model: Model, keys: list[tuple], params: Sequence[float], lower, upper, controls: IterationControls | None, options: SolverOptions | None) -> list[Found]:
    """Fits of groups of any size, numbered by ``__k``. In a pass each task sums up its rows, SUM_ROWS at a time, and sends one row per group."""
    c, o, p = controls or IterationControls(), options or SolverOptions(), len(params)
    lo, hi = (np.full(p, e) if v is None else np.asarray(v, float) for v, e in ((lower, -np.inf), (upper, np.inf)))
    if len(lo) != p or len(hi) != p:
        raise ArraySizeError("arrays of other sizes than expected")
    if o.method not in (LEVENBERG_MARQUARDT_UPDATE, QUADRATIC_UPDATE, NIELSEN_UPDATE):
        raise InvalidInputError("an unknown update method")
    _check_controls(c)
    columns = [f"s{i}" for i in range(3 + p * p + p)]
    schema = T.StructType([T.StructField("__k", T.IntegerType()), *[T.StructField(s, T.DoubleType()) for s in columns]])
    points = importable(rows.select("__k", "__x", "__y", "__w"))

    def run(asked: dict[int, np.ndarray]) -> dict[int, Point]:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, np.ndarray] = {}
            held, size = [], 0

            def add() -> None:
                m = np.concatenate(held)
                for k in np.unique(m[:, 0]).astype(int):
                    own = m[m[:, 0] == k]
                    total[k] = total.get(k, 0.0) + _sums(model, asked[k], own[:, 1].copy(), own[:, 2].copy(), own[:, 3].copy())

            for batch in batches:
                held.append(batch.to_numpy(float))
                size += len(batch)
                if size >= SUM_ROWS:
                    add()
                    held, size = [], 0
            if size:
                add()
            if total:
                yield pd.DataFrame([[k, *v] for k, v in total.items()], columns=["__k", *columns])

        going = points if len(asked) == len(keys) else points.filter(F.col("__k").isin(list(asked)))
        out = {}
        for row in going.mapInPandas(each, schema).groupBy("__k").agg(*[F.sum(s).alias(s) for s in columns]).collect():
            v = np.array(row[1:], float)
            out[row[0]] = Point(asked[row[0]], int(v[0]), float(v[1]), float(v[2]), v[3 : 3 + p * p].reshape(p, p), v[3 + p * p :])
        return out

    found = _searches({k: search(np.array(params, float), lo, hi, c, o) for k in range(len(keys))}, run)
    return [found[k] for k in range(len(keys))]


# --- fits of any size ---
#: Groups of one call of :func:`distributed_least_squares`: each is a row of p x p numbers on the driver. More groups are fitted side by side by :func:`nonlinear_least_squares`.
MOST_GROUPS = 10_000
#: Central differences: the step relative to a parameter (or to 1, if the parameter is less).
CENTRAL_STEP = float(np.cbrt(np.finfo(float).eps))

ColumnModel = Callable[[list[Column], list[Column]], Column]


@dataclass
class Point:
    """What one pass over the data says about parameters ``p``."""

    p: np.ndarray
    n: int
    chi: float
    squares: float
    h: np.ndarray
    g: np.ndarray


@dataclass
class Found:
    """Where a search ended: the best point, and why."""

    at: Point
    iterations: int
    evaluations: int
    values: dict[str, float]
    converged_on: set[str]
    stopped_by: str


def search(p: np.ndarray, lower: np.ndarray, upper: np.ndarray, c: IterationControls, o: SolverOptions, update: Callable[[int, np.ndarray], bool] | None = None) -> Generator[np.ndarray, Point, Found]:
    """Levenberg-Marquardt as a coroutine: it yields the parameters that it wants evaluated and is sent their :class:`Point`. The Jacobian is new at each point. A parameter at a bound that its gradient pushes against stays there for the step."""
    cost = 1 + 2 * len(p)
    now = yield np.clip(p, lower, upper)
    if now.n < len(p):
        raise UnderdefinedProblemError("fewer points than parameters")
    lam = 1e-2 if o.method == LEVENBERG_MARQUARDT_UPDATE else 1e-2 * float(np.diag(now.h).max())
    nu, it, calls, dof = 2.0, 0, cost, max(1, now.n - len(p))
    values = {"gradient": np.inf, "change": np.inf, "residual": np.inf}
    converged, stopped = set(), ""
    while not converged and not stopped:
        it += 1
        d = np.diag(np.diag(now.h)) if o.method == LEVENBERG_MARQUARDT_UPDATE else np.eye(len(p))
        free = ~(((now.p <= lower) & (now.g < 0)) | ((now.p >= upper) & (now.g > 0)))
        step = np.zeros(len(p))
        step[free] = np.linalg.lstsq((now.h + lam * d)[np.ix_(free, free)], now.g[free], rcond=None)[0] if free.any() else 0.0
        trial = yield np.clip(now.p + step, lower, upper)
        calls += cost
        alpha = 1.0
        if o.method == QUADRATIC_UPDATE:  # along the step to where a parabola through both ends has its least value
            slope = float(now.g @ step)
            bend = 0.5 * (trial.chi - now.chi) + 2 * slope
            alpha = abs(slope / bend) if bend else 1.0
            step = alpha * step
            trial = yield np.clip(now.p + step, lower, upper)
            calls += cost
        gain = abs(float(step @ (lam * (d @ step) + now.g)))
        rho = (now.chi - trial.chi) / gain if gain else (1.0 if trial.chi <= now.chi else -1.0)
        change = trial.chi - now.chi
        if np.isfinite(trial.chi) and rho > c.iteration_improvement_tolerance:
            now = trial
            if o.method == LEVENBERG_MARQUARDT_UPDATE:
                lam = max(lam / o.damping_decrease_factor, 1e-7)
            elif o.method == QUADRATIC_UPDATE:
                lam = max(lam / (1 + alpha), 1e-7)
            else:
                lam, nu = lam * max(1 / 3, 1 - (2 * rho - 1) ** 3), 2.0
        elif o.method == LEVENBERG_MARQUARDT_UPDATE:
            lam = min(lam * o.damping_increase_factor, 1e7)
        elif o.method == QUADRATIC_UPDATE:
            lam = lam + abs(change / 2 / alpha) if alpha and np.isfinite(change) else lam * o.damping_increase_factor
        else:
            lam, nu = lam * nu, nu * 2
        pushed = ((now.p <= lower) & (now.g < 0)) | ((now.p >= upper) & (now.g > 0))
        values = {"gradient": float(np.abs(np.where(pushed, 0.0, now.g)).max()), "change": float(np.max(np.abs(step) / (np.abs(now.p) + 1e-12))), "residual": now.chi / dof}
        if it > 2:
            limits = {"gradient": c.gradient_tolerance, "change": c.change_in_solution_tolerance, "residual": c.residual_tolerance}
            converged = {k for k, v in values.items() if v < limits[k]}
        if it >= c.max_iteration_count:
            stopped = "iterations"
        elif calls >= c.max_function_evaluations:
            stopped = "evaluations"
        elif update is not None and update(it, now.p):
            stopped = "user"
    return Found(now, it, calls, values, converged, stopped)


def _pass(rows: DataFrame, model: ColumnModel, by: list[str], asked: dict[tuple, np.ndarray], predictors: int) -> dict[tuple, Point]:
    """One aggregate over the rows of the asked groups: each group's parameters are broadcast to its rows."""
    spark, p = rows.sparkSession, len(next(iter(asked.values())))
    steps = {key: CENTRAL_STEP * np.maximum(np.abs(q), 1.0) for key, q in asked.items()}
    schema = T.StructType([*[T.StructField(f"__by{i}", rows.schema[b].dataType) for i, b in enumerate(by)], T.StructField("__p", T.ArrayType(T.DoubleType())), T.StructField("__s", T.ArrayType(T.DoubleType()))])
    table = spark.createDataFrame([(*key, q.tolist(), steps[key].tolist()) for key, q in asked.items()], schema)
    on = [F.col(b).eqNullSafe(F.col(f"__by{i}")) for i, b in enumerate(by)]
    with_p = rows.join(F.broadcast(table), on) if by else rows.crossJoin(F.broadcast(table))  # at most MOST_GROUPS rows
    x = [F.col(f"__x{i}") for i in range(predictors)]
    at, h = [F.get("__p", F.lit(i)) for i in range(p)], [F.get("__s", F.lit(i)) for i in range(p)]
    moved = lambda i, sign: model(x, [*at[:i], at[i] + sign * h[i], *at[i + 1 :]])
    keep = [*by, "__w", (F.col("__y") - model(x, at)).alias("__r"), *[((moved(i, 1.0) - moved(i, -1.0)) / (2 * h[i])).alias(f"__j{i}") for i in range(p)]]
    e = with_p.select(*keep)
    r, w, j = F.col("__r"), F.col("__w"), [F.col(f"__j{i}") for i in range(p)]
    upper = [F.sum(w * j[a] * j[b]) for a in range(p) for b in range(a, p)]
    sums = e.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.sum(w * r * r).alias("__chi"), F.sum(r * r).alias("__squares"), F.array(*upper).alias("__h"), F.array(*[F.sum(w * j[a] * r) for a in range(p)]).alias("__g"))
    out = {}
    for row in sums.collect():
        m = np.zeros((p, p))
        m[np.triu_indices(p)] = np.array(row["__h"], float)
        key = tuple(row[b] for b in by)
        chi = float("nan") if row["__chi"] is None else row["__chi"]
        out[key] = Point(asked[key], row["__n"], chi, row["__squares"], m + np.triu(m, 1).T, np.array(row["__g"], float))
    return out


def _searches(going: dict, run: Callable[[dict], dict]) -> dict:
    """All searches step together: ``run`` makes one pass over the data for the parameters that are asked for."""
    asked = {k: next(g) for k, g in going.items()}
    found: dict = {}
    while asked:
        seen = run(asked)
        missing = [k for k in asked if k not in seen]
        if missing:  # a frame without rows
            raise UnderdefinedProblemError("fewer points than parameters")
        for k in list(asked):
            try:
                asked[k] = going[k].send(seen[k])
            except StopIteration as end:
                found[k] = end.value
                del asked[k]
    return found


INFO = T.StructType([T.StructField(n, k()) for n, k in (("converge_on_gradient", T.BooleanType), ("gradient_value", T.DoubleType), ("converge_on_solution_change", T.BooleanType), ("solution_change_value", T.DoubleType), ("converge_on_residual_parameter", T.BooleanType), ("residual_value", T.DoubleType), ("reach_iteration_limit", T.BooleanType), ("reach_function_evaluation_limit", T.BooleanType), ("user_requested_stop", T.BooleanType), ("iteration_count", T.IntegerType), ("function_evaluation_count", T.IntegerType))])


def distributed_least_squares(df: DataFrame, model: ColumnModel, x: str | Sequence[str], y: str, params: Sequence[float] | dict[tuple, Sequence[float]], weight: str | None = None, by: Sequence[str] = (), lower: Sequence[float] | None = None, upper: Sequence[float] | None = None, controls: IterationControls | None = None, options: SolverOptions | None = None, alpha: float = 0.05, update: Callable[[tuple, int, np.ndarray], bool] | None = None) -> DataFrame:
    """A fit per group of any size: by, parameter, estimate, standard_error, t_statistic, probability, confidence_interval, covariance (the parameter's row), n, chi_squared, info.

    ``model(x, p)`` gives a column from the columns of the predictors ``x`` and of the
    parameters. ``params`` are the starting values, of all groups or by group key.
    ``update(key, iteration, p)`` may return True to stop a group. Rows with a null
    are left out; a null group key is a group. Statistics are of the unweighted
    residuals, like those of :func:`nonlinear_least_squares`; ``info`` tells what
    each test of convergence came to. Every pass reads the needed columns of ``df``
    once; give a table, not an expensive plan.
    """
    by, c, o = list(by), controls or IterationControls(), options or SolverOptions()
    names = [x] if isinstance(x, str) else list(x)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = [F.col(n).cast("double").alias(f"__x{i}") for i, n in enumerate(names)]
    rows = df.select(*by, *own, F.col(y).cast("double").alias("__y"), w.alias("__w")).dropna(subset=[f"__x{i}" for i in range(len(names))] + ["__y", "__w"])
    keys = [tuple(r) for r in rows.select(*by).distinct().limit(MOST_GROUPS + 1).collect()] if by else [()]
    if len(keys) > MOST_GROUPS:
        raise InvalidArgumentError(f"more than {MOST_GROUPS} groups: fit them side by side with nonlinear_least_squares")
    start = {k: np.array(params[k] if isinstance(params, dict) else params, float) for k in keys}
    p = len(next(iter(start.values()))) if start else 0
    lo, hi = (np.full(p, e) if v is None else np.asarray(v, float) for v, e in ((lower, -np.inf), (upper, np.inf)))
    if len(lo) != p or len(hi) != p or any(len(q) != p for q in start.values()):
        raise ArraySizeError("arrays of other sizes than expected")
    if o.method not in (LEVENBERG_MARQUARDT_UPDATE, QUADRATIC_UPDATE, NIELSEN_UPDATE):
        raise InvalidInputError("an unknown update method")
    _check_controls(c)
    going = {k: search(q, lo, hi, c, o, None if update is None else (lambda it, at, k=k: update(k, it, at))) for k, q in start.items()}
    found = _searches(going, lambda asked: _pass(rows, model, by, asked, len(names)))
    out = []
    for k, f in found.items():
        covariance = np.linalg.pinv(f.at.h, rcond=1e-14, hermitian=True)
        for i, s in enumerate(_coefficients(f.at.p, covariance, f.at.n, f.at.squares, alpha)):
            info = ("gradient" in f.converged_on, f.values["gradient"], "change" in f.converged_on, f.values["change"], "residual" in f.converged_on, f.values["residual"], f.stopped_by == "iterations", f.stopped_by == "evaluations", f.stopped_by == "user", f.iterations, f.evaluations)
            out.append((*k, i, float(f.at.p[i]), *s.values(), covariance[i].tolist(), int(f.at.n), float(f.at.chi), info))
    schema = T.StructType([*[rows.schema[b] for b in by], T.StructField("parameter", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in ("estimate", "standard_error", "t_statistic", "probability", "confidence_interval")], T.StructField("covariance", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType()), T.StructField("chi_squared", T.DoubleType()), T.StructField("info", INFO)])
    return df.sparkSession.createDataFrame(out, schema)


def predict(df: DataFrame, fit: DataFrame, model: ColumnModel, x: str | Sequence[str], y: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with modelled (and residual = y - modelled). ``fit`` has parameter and estimate per group; it is broadcast if it has at most MOST_GROUPS groups. Groups without a fit get nulls."""
    names, by = [x] if isinstance(x, str) else list(x), list(by)
    p = fit.groupBy(*[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)]).agg(F.transform(F.sort_array(F.collect_list(F.struct("parameter", "estimate"))), lambda z: z["estimate"]).alias("__p"))
    size = p.agg(F.max(F.size("__p")), F.count(F.lit(1))).first()
    p = F.broadcast(p) if size[1] <= MOST_GROUPS else p
    rows = df.join(p, [F.col(b).eqNullSafe(F.col(f"__by{i}")) for i, b in enumerate(by)], "left") if by else df.crossJoin(p)
    out = rows.withColumn("modelled", model([F.col(n).cast("double") for n in names], [F.get("__p", F.lit(i)) for i in range(size[0] or 0)]))
    return (out if y is None else out.withColumn("residual", F.col(y) - F.col("modelled"))).drop("__p", *[f"__by{i}" for i in range(len(by))])
