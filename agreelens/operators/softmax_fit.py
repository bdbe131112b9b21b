"""Many softmax regressions at once: every pass over the rows serves all problems that are still open.

A problem is a layer and the fold it leaves out (or none). Its rows are the layer's other folds, so all folds of a layer are served by
one read of the layer: each task evaluates its rows at the weights of every problem they belong to and returns sums. Only
vectors as long as a model travel to the driver; Hessians are summed and solved in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Up to so many parameters a problem takes Newton steps; a longer one takes quasi-Newton steps from its last ``MEMORY`` gradients.
MAX_HESSIAN = 1000
MEMORY = 8

Key = tuple[int, int]
#: The left-out fold of a problem that leaves none out.
NO_FOLD = -1


@dataclass
class Problem:
    """One regression: its classes, its weights (a row per class; for two classes one row, that of the second), and the state of its search.

    The objective is the summed log loss plus ``penalty / 2`` times the squared weights without intercepts, as many toolkits have it.
    """

    layer: int
    held: int
    classes: tuple[int, ...]
    n: int
    width: int
    weights: np.ndarray = field(init=False)
    trial: np.ndarray = field(init=False)
    value: float = np.inf
    step: float = 1.0
    passes: int = 0
    open: bool = True
    gradient: np.ndarray | None = None
    direction: np.ndarray | None = None
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def __post_init__(self) -> None:
        rows = 1 if len(self.classes) == 2 else len(self.classes)
        self.weights = self.trial = np.zeros((rows, self.width + 1))

    @property
    def newton(self) -> bool:
        return self.trial.size <= MAX_HESSIAN

    def take(self, value: float, gradient: np.ndarray, direction: np.ndarray | None) -> None:
        """Accept the trial weights if the objective fell enough, and set out the next ones; else shorten the step."""
        self.passes += 1
        if self.direction is not None:
            expected = self.step * float((self.gradient * self.direction).sum())
            # Near the optimum the fall is below what doubles resolve.
            if not value <= self.value + 1e-4 * expected + 1e-12 * abs(self.value):
                self.step /= 2
                self.open = self.step > 1e-10
                self.trial = self.weights + self.step * self.direction
                return
            moved, turned = self.trial - self.weights, gradient - self.gradient
            if direction is None and (moved * turned).sum() > 1e-12 * (turned * turned).sum():
                self.pairs = [*self.pairs[1 - MEMORY :], (moved, turned)]
        self.weights, self.value, self.gradient = self.trial, value, gradient
        self.direction = self._quasi_newton(gradient) if direction is None else direction
        self.step = 1.0 if self.newton or self.pairs else 1.0 / max(1.0, float(np.abs(gradient).sum()))
        fall = -float((gradient * self.direction).sum())
        self.open = fall > (1e-16 if self.newton else 1e-12) * (1.0 + abs(value))
        self.trial = self.weights + self.step * self.direction
        if self.newton and not self.open:
            # The last direction is at hand already, and its step squares the error once more.
            self.weights = self.trial

    def _quasi_newton(self, gradient: np.ndarray) -> np.ndarray:
        q, steps = gradient.copy(), []
        for moved, turned in reversed(self.pairs):
            a = (moved * q).sum() / (moved * turned).sum()
            q -= a * turned
            steps.append(a)
        if self.pairs:
            moved, turned = self.pairs[-1]
            q *= (moved * turned).sum() / (turned * turned).sum()
        for (moved, turned), a in zip(self.pairs, reversed(steps)):
            q += (a - (turned * q).sum() / (moved * turned).sum()) * moved
        return -q


def matrix_of(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as a matrix with a last column of ones; vectors of unlike length, or with nulls, stop the job."""
    flat = vectors.flatten()
    n = len(vectors)
    width = len(flat) // n if width is None else width
    lengths = np.diff(vectors.offsets.to_numpy()[: n + 1])
    if flat.null_count or (lengths != width).any():
        raise ValueError(f"representations of one layer must all have {width} numbers")
    out = np.ones((n, width + 1))
    out[:, :width] = flat.to_numpy(zero_copy_only=False).reshape(n, width)
    return out


def class_logits(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ weights.T
    return np.hstack([np.zeros((len(x), 1)), z]) if weights.shape[0] == 1 else z


def probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = class_logits(x, weights)
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _sums(x: np.ndarray, place: np.ndarray, weights: np.ndarray, hessian: bool) -> tuple[float, np.ndarray, np.ndarray | None]:
    """Log loss, its gradient and Hessian over some rows; ``place`` is each row's class by its place among the classes."""
    z = class_logits(x, weights)
    top = z.max(axis=1)
    p = np.exp(z - top[:, None])
    total = p.sum(axis=1)
    loss = float((np.log(total) + top - z[np.arange(len(x)), place]).sum())
    p /= total[:, None]
    wrong = p.copy()
    wrong[np.arange(len(x)), place] -= 1.0
    p, wrong = (p[:, 1:], wrong[:, 1:]) if weights.shape[0] == 1 else (p, wrong)
    if not hessian:
        return loss, wrong.T @ x, None
    k, d = weights.shape
    full = np.empty((k, d, k, d))
    for a in range(k):
        for b in range(a, k):
            block = (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
            full[a, :, b, :] = block
            full[b, :, a, :] = block
    return loss, wrong.T @ x, full.reshape(k * d, k * d)


_PARTIAL = "layer int, held int, value double, gradient binary, hessian binary"
_SUMMED = "layer int, held int, value double, gradient binary, direction binary"
_ARROW = {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}


def _batch(kinds: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in kinds.split(", "))])
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def one_pass(rows: DataFrame, problems: list[Problem], penalty: float) -> dict[Key, tuple[float, np.ndarray, np.ndarray | None]]:
    """Objective, gradient and, for Newton problems, direction at each problem's trial weights: one job, however many problems."""
    todo: dict[int, list] = {}
    for q in problems:
        todo.setdefault(q.layer, []).append((q.held, q.classes, q.trial, q.newton))
    shared = rows.sparkSession.sparkContext.broadcast(todo)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[Key, list] = {}
        for batch in batches:
            layers, folds, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for layer in np.unique(layers):
                own = np.flatnonzero(layers == layer)
                wanted = shared.value.get(int(layer))
                if not wanted:
                    continue
                x = matrix_of(batch.column(3).take(pa.array(own)), wanted[0][2].shape[1] - 1)
                for held, classes, weights, newton in wanted:
                    used = folds[own] != held
                    if not used.any():
                        continue
                    place = np.searchsorted(np.array(classes), labels[own][used])
                    found = _sums(x[used], place, weights, newton)
                    total = sums.setdefault((int(layer), held), [0.0, 0.0, 0.0 if newton else None])
                    for i, part in enumerate(found):
                        if part is not None:
                            total[i] = total[i] + part
        # One row per batch: Hessians may be large.
        for (layer, held), (value, gradient, hessian) in sums.items():
            yield _batch(_PARTIAL, [(layer, held, value, gradient.tobytes(), None if hessian is None else hessian.tobytes())])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Partial sums arrive one after the other, so a task holds two Hessians.
        total: list | None = None
        key = None
        for batch in batches:
            for row in batch.to_pylist():
                key = row["layer"], row["held"]
                parts = [row["value"], np.frombuffer(row["gradient"]), row["hessian"] and np.frombuffer(row["hessian"])]
                total = parts if total is None else [a if b is None else a + b for a, b in zip(total, parts)]
        weights = next(w for held, _, w, _ in shared.value[key[0]] if held == key[1])
        k, d = weights.shape
        decay = np.ones((k, d)) * penalty
        decay[:, -1] = 0.0
        value = total[0] + 0.5 * float((decay * weights * weights).sum())
        gradient = total[1].reshape(k, d) + decay * weights
        direction = None
        if total[2] is not None:
            h = total[2].reshape(k * d, k * d) + np.diag(decay.ravel())
            if k > 1:
                # Intercepts may all move alike without a change; this keeps their sum at zero.
                at = np.arange(k) * d + d - 1
                h[np.ix_(at, at)] += 1.0
            direction = np.linalg.lstsq(h, -gradient.ravel(), rcond=None)[0].tobytes()
        yield _batch(_SUMMED, [(*key, value, gradient.tobytes(), direction)])

    named = rows.select("layer", "fold", "label", "vec")
    found = named.mapInArrow(partial, _PARTIAL).groupBy("layer", "held").applyInArrow(solved, _SUMMED).collect()
    shared.destroy()
    shapes = {(q.layer, q.held): q.trial.shape for q in problems}
    return {
        (r["layer"], r["held"]): (
            r["value"],
            np.frombuffer(r["gradient"]).reshape(shapes[r["layer"], r["held"]]),
            None if r["direction"] is None else np.frombuffer(r["direction"]).reshape(shapes[r["layer"], r["held"]]),
        )
        for r in found
    }


def solve(rows: DataFrame, problems: list[Problem], c: float = 1.0, max_passes: int = 2000) -> None:
    """Fit all problems; ``rows`` has ``layer, fold, label, vec`` and should be staged, since every pass reads it.

    ``1 / c`` is the penalty. A problem that has converged takes no part in later passes.
    """
    for _ in range(max_passes):
        still = [q for q in problems if q.open]
        if not still:
            return
        found = one_pass(rows, still, 1.0 / c)
        for q in still:
            q.take(*found[q.layer, q.held])
