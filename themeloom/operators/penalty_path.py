"""Ridge and lasso logits for all penalties and folds from shared scans of the rows.

Every pair of a training set (all rows but one fold, or all rows) and a penalty is a candidate. One scan
gives losses and gradients of every unfinished candidate at its own next point, so the number of scans is
that of the slowest candidate, not the sum over all. Tasks hold one row of numbers for each candidate, which
are summed in blocks on the executors.

Candidates of one training set differ in the penalty only, so a point, its loss and its curvature found for
one serve the others: a candidate moves to its neighbour's point where its own objective is lower there.
For the lasso the duality gap says which coefficients are zero in the solution; those leave the scans.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import digest_number

BLOCK = 8192
CELLS_AT_ONCE = 4_000_000
MEMORY = 8
SUMMED = "part int, block int, values binary"


@dataclass
class Point:
    """Coefficients on the scale of standardised features, with the mean loss, its gradient and curvature pairs."""

    x: np.ndarray
    loss: float
    gradient: np.ndarray
    entropy: float
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


@dataclass
class Candidate:
    group: int  # the fold left out, or the number of folds for all rows
    place: int  # on the path of penalties
    penalty: float
    at: Point
    inside: np.ndarray  # coefficients that may differ from zero
    trial: np.ndarray | None = None
    step: float = 1.0
    direction: np.ndarray | None = None
    forced: bool = False
    done: bool = False
    small: int = 0  # steps in a row that gained little


@dataclass
class PathModel:
    """The path of a kind: coefficients of every training set and penalty, errors, and the chosen penalty."""

    kind: str
    penalties: list[float]
    coefficients: np.ndarray  # training set x penalty x feature, for features as they are
    intercepts: np.ndarray  # training set x penalty
    feil: np.ndarray  # fold x penalty: share of the fold that is classed wrongly
    avvik: np.ndarray  # training set x penalty: largest violation of the optimality condition
    expected: np.ndarray  # training set x penalty x feature: what the mean of feature times label must be
    scans: int
    features: list[str]

    @property
    def chosen(self) -> int:
        """The place of the penalty with the smallest mean error; the larger penalty on a tie."""
        return int(np.argmin(np.round(self.feil.mean(axis=0), 12)))

    def transform(self, df: DataFrame, place: int | None = None) -> DataFrame:
        """Adds `probability` (both classes) and `prediction` by the coefficients from all rows."""
        place = self.chosen if place is None else place
        share = df.sparkSession.sparkContext.broadcast(
            (self.coefficients[-1, place], float(self.intercepts[-1, place]))
        )

        @F.arrow_udf("double")
        def positive(indices: pa.Array, values: pa.Array) -> pa.Array:
            weights, start = share.value
            sums = _products(*_sparse(indices, values), weights[None, :])[:, 0] + start
            return pa.array(_logistic(sums))

        indices, values = _entries(df, self.features)
        scored = df.withColumn("_p", positive(indices, values))
        both = array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))
        return scored.withColumns({"probability": both, "prediction": (F.col("_p") > 0.5).cast("double")}).drop("_p")

    def curve(self) -> list[tuple[float, float, float]]:
        """(penalty, mean error, deviation over the folds)."""
        return [(p, float(e.mean()), float(e.std())) for p, e in zip(self.penalties, self.feil.T, strict=True)]


def _entries(df: DataFrame, features: Sequence[str]) -> tuple[Column, Column]:
    """Places and values of the features that are not zero; places are empty where all values are given."""
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType, VectorUDT):
        parts = F.unwrap_udt(F.col(features[0]))
        return F.coalesce(parts["indices"], F.array().cast("array<int>")), parts["values"]
    return F.array().cast("array<int>"), F.array(*[F.col(f).cast("double") for f in features])


def _sparse(indices: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each row and the end, places, values) of Arrow lists."""
    counts = np.asarray(values.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    given = np.asarray(indices.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    starts = np.r_[0, np.cumsum(counts)]
    flat = values.flatten().to_numpy(zero_copy_only=False)
    places = np.arange(len(flat)) - np.repeat(starts[:-1], counts)
    listed = np.repeat(given == counts, counts)
    places[listed] = indices.flatten().to_numpy(zero_copy_only=False)
    return starts, places, flat


def _products(starts: np.ndarray, places: np.ndarray, flat: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows times weights (columns by features), for rows given by their entries.

    One column at a time, which passes over numbers that lie side by side.
    """
    out = np.zeros((len(weights), len(starts) - 1))
    filled = np.flatnonzero(np.diff(starts))
    if len(filled):
        for column, own in zip(out, weights, strict=True):
            column[filled] = np.add.reduceat(flat * own[places], starts[filled])
    return out.T


def _logistic(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -x))


def _pieces(batches: Iterator[pa.RecordBatch], width: int):
    """(fold, label, starts, places, values) of so many rows that entries times width stay bounded."""
    for batch in batches:
        fold, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts, places, flat = _sparse(batch.column(2), batch.column(3))
        if np.isnan(flat).any() or np.isnan(label).any():
            raise ValueError("a feature or label is missing")
        first = 0
        while first < len(fold):
            last = int(np.searchsorted(starts, starts[first] + CELLS_AT_ONCE // max(1, width), side="right")) - 1
            last = min(len(fold), max(first + 1, last))
            cut = slice(starts[first], starts[last])
            yield fold[first:last], label[first:last], starts[first : last + 1] - starts[first], places[cut], flat[cut]
            first = last


def _add_columns(total: np.ndarray, starts: np.ndarray, places: np.ndarray, flat: np.ndarray, parts: np.ndarray) -> None:
    """total[column, feature] += value * parts[row, column] over all entries."""
    counts = np.diff(starts)
    for column, own in zip(total, parts.T, strict=True):
        column += np.bincount(places, flat * np.repeat(own, counts), minlength=len(column))


def _blocks(total: np.ndarray, extra: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each part and block: columns of extra, then those of total."""
    whole = np.concatenate([extra.T, total], axis=1)
    for start in range(0, whole.shape[1], BLOCK):
        cut = whole[:, start : start + BLOCK]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(cut)), pa.int32()),
                pa.array(np.full(len(cut), start // BLOCK), pa.int32()),
                pa.array([values.tobytes() for values in cut], pa.binary()),
            ],
            names=["part", "block", "values"],
        )


def _summed(rows: DataFrame, task, parts: int, width: int) -> np.ndarray:
    """Sums of the blocks of all tasks, parts x width."""

    def add(batches):
        sums = {}
        for batch in batches:
            for part, block, values in zip(*batch.to_pydict().values(), strict=True):
                found = np.frombuffer(values)
                sums[part, block] = sums[part, block] + found if (part, block) in sums else found
        for (part, block), values in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([values.tobytes()], pa.binary())],
                names=["part", "block", "values"],
            )

    # A task sends each block once, as bytes, which no engine has to take apart on the way.
    table = rows.mapInArrow(task, SUMMED).repartition("part", "block").mapInArrow(add, SUMMED).toArrow()
    out = np.zeros((parts, width))
    for part, block, values in zip(*table.to_pydict().values(), strict=True):
        found = np.frombuffer(values)
        out[part, block * BLOCK : block * BLOCK + len(found)] = found
    return out


def _moments(rows: DataFrame, folds: int, width: int) -> np.ndarray:
    """For each fold: rows, ones, then for each feature the sums of x, x * x and x * y; folds x (2 + 3 * width)."""

    def task(batches):
        total, extra = np.zeros((folds, 3 * width)), np.zeros((2, folds))
        for fold, label, starts, places, flat in _pieces(batches, folds):
            own = (fold[:, None] == np.arange(folds)).astype(float)
            extra[0] += own.sum(axis=0)
            extra[1] += label @ own
            for i, (values, parts) in enumerate([(flat, own), (flat * flat, own), (flat, own * label[:, None])]):
                _add_columns(total[:, i * width : (i + 1) * width], starts, places, values, parts)
        yield from _blocks(total, extra)

    return _summed(rows, task, folds, 2 + 3 * width)


def _scan(rows: DataFrame, groups: np.ndarray, weights: np.ndarray, starts: np.ndarray, used: np.ndarray) -> np.ndarray:
    """For each candidate over its own rows: loss, sum of p log p + q log q, sum of p - y, wrong among the rows of
    the fold it leaves out, then the sums of (p - y) * x for the features in `used`."""
    spark = rows.sparkSession
    number = np.full(weights.shape[0], -1)
    number[used] = np.arange(len(used))
    shared = spark.sparkContext.broadcast((groups, np.ascontiguousarray(weights[used].T), starts, number))

    def task(batches):
        group, w, start, place = shared.value
        total, extra = np.zeros(w.shape), np.zeros((4, len(group)))
        for fold, label, bounds, places, flat in _pieces(batches, len(group)):
            # Places out of use have the number -1; their entries are left out.
            at = place[places]
            keep = at >= 0
            bounds = np.r_[0, np.cumsum(keep)][bounds]
            at, flat = at[keep], flat[keep]
            sums = _products(bounds, at, flat, w) + start
            own = fold[:, None] != group
            p = _logistic(sums)
            rest = np.where(own, p - label[:, None], 0.0)
            extra[0] += np.where(own, np.logaddexp(0.0, sums) - label[:, None] * sums, 0.0).sum(axis=0)
            with np.errstate(divide="ignore", invalid="ignore"):
                entropy = np.nan_to_num(p * np.log(p)) + np.nan_to_num((1 - p) * np.log1p(-p))
            extra[1] += np.where(own, entropy, 0.0).sum(axis=0)
            extra[2] += rest.sum(axis=0)
            extra[3] += (~own & ((sums > 0) != (label[:, None] > 0.5))).sum(axis=0)
            _add_columns(total, bounds, at, flat, rest)
        yield from _blocks(total, extra)

    found = _summed(rows, task, len(groups), 4 + len(used))
    shared.unpersist()
    return found


def fit_path(
    kind: str,
    df: DataFrame,
    label: str,
    features: Sequence[str],
    penalties: Sequence[float],
    folds: int = 5,
    id: str = "id",
    seed: int = 0,
    tol: float = 1e-6,
    gain: float = 0.0,
    max_scans: int = 150,
) -> PathModel:
    """Logits of a 0/1 label for all penalties, on the rows outside each fold and on all rows.

    kind: ridge (with an intercept) or lasso (without). The objective is the mean loss plus the penalty times half
    the squares, or the absolute values, of the coefficients of features divided by their deviation in the training
    set; a feature without deviation there keeps 0. The features are numbers, or one vector column. A candidate is
    done when its optimality condition is violated by at most tol, for the lasso also when its duality gap is at
    most tol * tol, and where gain is given also after two steps in a row that lower the objective by at most that
    share; `avvik` of the result says what was reached after max_scans.

    A missing label or feature is an error, and so is an empty table. A missing id counts as one id. The rows of
    numbers that the scans read are kept while the path is fitted. Each task of a scan sends one set of sums, so a
    table in more partitions than there are cores only sends more. The driver holds (folds + 1) * penalties * features numbers,
    times 18 at most for the curvature of candidates that share none.
    """
    if kind not in ("ridge", "lasso"):
        raise ValueError(kind)
    fold = digest_number(id, seed=seed, modulus=folds).cast("int")
    y = F.coalesce(F.col(label).cast("double"), F.lit(float("nan")))
    indices, values = _entries(df, features)
    filled = F.transform(values, lambda v: F.coalesce(v, F.lit(float("nan"))))
    rows = df.select(fold.alias("fold"), y.alias("y"), indices.alias("indices"), filled.alias("values"))
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType, VectorUDT):
        first = df.select(F.unwrap_udt(F.col(features[0])).alias("x")).select(
            F.coalesce("x.size", F.size("x.values"))
        ).first()
        width = first[0] if first else 0
    else:
        width = len(features)

    rows = rows.persist()
    try:
        return _fitted_path(rows, kind, penalties, folds, width, tol, gain, max_scans, list(features))
    finally:
        rows.unpersist()


def _fitted_path(
    rows: DataFrame,
    kind: str,
    penalties: Sequence[float],
    folds: int,
    width: int,
    tol: float,
    gain: float,
    max_scans: int,
    features: list[str],
) -> PathModel:
    """`fit_path` on its rows (fold, y, indices, values)."""
    sums = _moments(rows, folds, width)
    sums = np.concatenate([sums.sum(axis=0) - sums, sums.sum(axis=0)[None]])  # every training set
    n, ones = sums[:, 0], sums[:, 1]
    if not n.all():
        raise ValueError("a training set is empty")
    total, squares, marked = np.split(sums[:, 2:], 3, axis=1)
    mean = total / n[:, None]
    # A deviation is zero where rounding alone is left of the squares.
    spread = np.maximum(0.0, squares / n[:, None] - mean**2)
    spread[spread <= 1e-12 * squares / n[:, None]] = 0.0
    deviation = np.sqrt(spread * (n / np.maximum(n - 1, 1))[:, None])
    # Features that are the same in every row of every training set keep 0 and take no part.
    whole_marked, whole_deviation = marked, deviation
    kept, all_features = np.flatnonzero(deviation.any(axis=0)), width
    total, squares, marked, mean, deviation = (a[:, kept] for a in (total, squares, marked, mean, deviation))
    width = len(kept)
    unit = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
    centre = mean if kind == "ridge" else np.zeros_like(mean)
    lengths = np.sqrt(squares) * unit

    candidates = []
    for g in range(folds + 1):
        x = np.zeros(width + 1)
        share = float(np.clip(ones[g] / n[g], 1e-9, 1 - 1e-9)) if kind == "ridge" else 0.5
        x[-1] = np.log(share / (1 - share))
        rest = share * n[g] - ones[g]
        gradient = _gradient(share * total[g] - marked[g], rest, centre[g], unit[g], n[g], kind)
        loss = -(ones[g] * np.log(share) + (n[g] - ones[g]) * np.log(1 - share)) / n[g]
        entropy = share * np.log(share) + (1 - share) * np.log(1 - share)
        start = Point(x, loss, gradient, entropy)
        inside = np.r_[deviation[g] > 0, kind == "ridge"]
        candidates += [Candidate(g, i, float(p), start, inside) for i, p in enumerate(penalties)]

    scans = 1
    while scans < max_scans:
        for c in candidates:
            if not c.done and c.trial is None:
                _next_trial(c, kind, tol, n[c.group], lengths[c.group])
        active = [c for c in candidates if not c.done]
        if not active:
            break
        used = np.flatnonzero(np.any([c.inside[:-1] for c in active], axis=0))
        found = _evaluate(rows, active, kept[used], unit, centre, [c.trial for c in active], kept, all_features)
        scans += 1
        for c, row in zip(active, found, strict=True):
            g = c.group
            whole = np.zeros(width)
            whole[used] = row[4:]
            gradient = _gradient(whole, row[2], centre[g], unit[g], n[g], kind)
            _take(c, Point(c.trial, row[0] / n[g], gradient, row[1] / n[g]), kind, gain)
        _share(candidates, kind)

    everything, points = np.arange(all_features), [c.at.x for c in candidates]
    found = _evaluate(rows, candidates, everything, unit, centre, points, kept, all_features)
    shape = (folds + 1, len(penalties))
    model = PathModel(
        kind, [float(p) for p in penalties], np.zeros((*shape, all_features)), np.zeros(shape),
        np.zeros((folds, shape[1])), np.zeros(shape), np.zeros((*shape, all_features)), scans + 1, features,
    )
    for c, row in zip(candidates, found, strict=True):
        g, i, x = c.group, c.place, c.at.x
        w, model.intercepts[g, i] = _as_given(x, unit[g], centre[g])
        model.coefficients[g, i, kept] = w
        if g < folds:
            model.feil[g, i] = row[3] / max(1.0, n[folds] - n[g])
        gradient = _gradient(row[4:][kept], row[2], centre[g], unit[g], n[g], kind)
        inside = np.r_[deviation[g] > 0, kind == "ridge"]
        model.avvik[g, i] = np.abs(_steepest(x, gradient, c.penalty, inside, kind)).max()
        # The subgradient of the penalty, at its nearest to the condition.
        z = np.zeros(all_features)
        if kind == "ridge":
            z[kept] = x[:-1]
        else:
            z[kept] = np.where(x[:-1] != 0, np.sign(x[:-1]), np.clip(-gradient[:-1] / c.penalty, -1, 1))
        model.expected[g, i] = (row[4:] + whole_marked[g]) / n[g] + c.penalty * z * whole_deviation[g]
    return model


def _as_given(x: np.ndarray, unit: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and intercept for features as they are."""
    w = x[:-1] * unit
    return w, float(x[-1] - w @ centre)


def _evaluate(rows, candidates, used, unit, centre, points, kept, all_features) -> np.ndarray:
    """One scan at a point for each candidate; `used` and the results count all features, points the kept ones."""
    weights, starts = np.zeros((all_features, len(candidates))), np.zeros(len(candidates))
    for i, (c, x) in enumerate(zip(candidates, points, strict=True)):
        weights[kept, i], starts[i] = _as_given(x, unit[c.group], centre[c.group])
    return _scan(rows, np.array([c.group for c in candidates]), weights, starts, used)


def _gradient(sums, rest, centre, unit, n, kind) -> np.ndarray:
    """Gradient of the mean loss for standardised features, the intercept last."""
    return np.r_[(sums - centre * rest) * unit, rest if kind == "ridge" else 0.0] / n


def _objective(point: Point, penalty: float, kind: str) -> float:
    beta = point.x[:-1]
    return point.loss + penalty * (0.5 * float(beta @ beta) if kind == "ridge" else float(np.abs(beta).sum()))


def _steepest(x: np.ndarray, gradient: np.ndarray, penalty: float, inside: np.ndarray, kind: str) -> np.ndarray:
    """The gradient of the objective; for the lasso the subgradient nearest to zero."""
    if kind == "ridge":
        out = gradient + penalty * np.r_[x[:-1], 0.0]
    else:
        shrunk = np.sign(gradient) * np.maximum(0.0, np.abs(gradient) - penalty)
        out = np.where(x != 0, gradient + penalty * np.sign(x), shrunk)
    return np.where(inside, out, 0.0)


def _next_trial(c: Candidate, kind: str, tol: float, n: float, lengths: np.ndarray) -> None:
    """Marks the candidate done, or sets the next point to look at."""
    if kind == "lasso":
        # Duality gap at the scaled residuals; -entropy bounds their dual value, as the conjugate is convex.
        top = float(np.abs(c.at.gradient[c.inside]).max(initial=0.0))
        scale = min(1.0, c.penalty / top) if top else 1.0
        gap = max(0.0, _objective(c.at, c.penalty, kind) + scale * c.at.entropy)
        reach = scale * np.abs(c.at.gradient[:-1]) + lengths * np.sqrt(gap / (2 * n))
        c.inside = c.inside & np.r_[reach >= c.penalty * (1 - 1e-9), False]
        if gap <= tol * tol and not c.at.x[~c.inside].any():
            c.done = True
            return
        if c.at.x[~c.inside].any():
            c.trial, c.forced = np.where(c.inside, c.at.x, 0.0), True
            return
    steepest = _steepest(c.at.x, c.at.gradient, c.penalty, c.inside, kind)
    if np.abs(steepest).max(initial=0.0) <= tol:
        c.done = True
        return
    direction = -_curved(steepest, c, kind)
    direction[~c.inside] = 0.0
    if kind == "lasso":
        direction = np.where(direction * steepest < 0, direction, 0.0)
    if float(direction @ steepest) >= 0:
        c.at.pairs = []
        direction = -steepest
    c.direction = direction
    c.step = 1.0 if c.at.pairs else min(1.0, 1.0 / float(np.abs(direction).sum()))
    _set_trial(c, steepest, kind)


def _set_trial(c: Candidate, steepest: np.ndarray, kind: str) -> None:
    c.trial = c.at.x + c.step * c.direction
    if kind == "lasso":
        side = np.where(c.at.x != 0, np.sign(c.at.x), -np.sign(steepest))
        c.trial = np.where(c.trial * side > 0, c.trial, 0.0)


def _curved(gradient: np.ndarray, c: Candidate, kind: str) -> np.ndarray:
    """The gradient times the inverse curvature that the pairs tell of (limited-memory BFGS)."""
    inside = np.flatnonzero(c.inside)
    pairs = []
    for s, y in c.at.pairs:
        part, whole = s[inside], y[inside]
        if kind == "ridge":
            whole += c.penalty * np.where(inside < len(s) - 1, part, 0.0)
        product = float(part @ whole)
        if product > 1e-14 * float(whole @ whole):
            pairs.append((part, whole, product))
    moved, factors = gradient[inside], []
    for s, y, product in reversed(pairs):
        a = float(s @ moved) / product
        moved -= a * y
        factors.append(a)
    if pairs:
        s, y, product = pairs[-1]
        moved *= product / float(y @ y)
    for (s, y, product), a in zip(pairs, reversed(factors), strict=True):
        moved += (a - float(y @ moved) / product) * s
    out = np.zeros_like(gradient)
    out[inside] = moved
    return out


def _take(c: Candidate, found: Point, kind: str, gain: float) -> None:
    """Goes to the point looked at where the objective fell enough, else looks nearer."""
    steepest = _steepest(c.at.x, c.at.gradient, c.penalty, c.inside, kind)
    moved = found.x - c.at.x
    now = _objective(c.at, c.penalty, kind)
    wanted = now + 1e-4 * float(steepest @ moved) + 1e-15 * abs(now)
    if c.forced or _objective(found, c.penalty, kind) <= wanted:
        if not c.forced:
            c.small = c.small + 1 if now - _objective(found, c.penalty, kind) <= gain * abs(now) else 0
            c.done = gain > 0 and c.small >= 2
            found.pairs = [*c.at.pairs, (moved, found.gradient - c.at.gradient)][-MEMORY:]
        c.at, c.trial, c.forced = found, None, False
        return
    c.step *= 0.3
    if c.step < 1e-12 or not moved.any():
        if not c.at.pairs:
            c.done = True  # rounding leaves no lower point
        c.at = Point(c.at.x, c.at.loss, c.at.gradient, c.at.entropy)
        c.trial = None
        return
    _set_trial(c, steepest, kind)


def _share(candidates: list[Candidate], kind: str) -> None:
    """Moves candidates to the point of a neighbour on the path, with its curvature, where that is lower for them."""
    by = {(c.group, c.place): c for c in candidates}
    before = {key: c.at for key, c in by.items()}
    for (group, place), c in by.items():
        if c.done:
            continue
        for other in (place - 1, place + 1):
            point = before.get((group, other))
            if point is None or point.x[~c.inside].any():
                continue
            if _objective(point, c.penalty, kind) < _objective(c.at, c.penalty, kind) - 1e-12:
                c.at, c.trial, c.forced = Point(point.x, point.loss, point.gradient, point.entropy, list(point.pairs)), None, False
