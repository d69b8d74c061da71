"""Hyper-parameter search and early stopping; the driver decides, every trial is a distributed job."""

from __future__ import annotations

import itertools
import json
import math
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Space:
    """One parameter: a range (low, high), integer or real, linear or log, or a list of choices."""

    low: float = 0.0
    high: float = 1.0
    integer: bool = False
    log: bool = False
    choices: tuple = ()

    def at(self, u: float):
        """The value at u in [0, 1)."""
        if self.choices:
            return self.choices[min(int(u * len(self.choices)), len(self.choices) - 1)]
        x = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low))) if self.log else self.low + u * (self.high - self.low)
        return int(round(x)) if self.integer else float(x)


@dataclass
class Result:
    """Trials in order: parameters, metrics; and the best."""

    trials: list[tuple[dict, float]] = field(default_factory=list)

    @property
    def best(self) -> tuple[dict, float]:
        return max(self.trials, key=lambda t: -math.inf if math.isnan(t[1]) else t[1])

    def frame(self, spark):
        return spark.createDataFrame([(k, p, str(v), float(s)) for k, (ps, s) in enumerate(self.trials) for p, v in sorted(ps.items())], "case_id int, parameter string, value string, metric double")


def grid(choices: dict[str, list]) -> list[dict]:
    return [dict(zip(choices, v)) for v in itertools.product(*choices.values())]


def save_trials(path: str, result: Result) -> None:
    """Write the trials as JSON under a temporary name, then put it in place."""
    with open(f"{path}.new", "w") as f:
        json.dump([[p, None if math.isnan(s) else s] for p, s in result.trials], f)
    os.replace(f"{path}.new", path)


def load_trials(path: str) -> Result:
    """The trials of an earlier search; none if there is no file."""
    if not os.path.exists(path):
        return Result()
    with open(path) as f:
        return Result([(p, math.nan if s is None else s) for p, s in json.load(f)])


def run_cases(cases: list[dict], objective: Callable[[dict], float], result: Result | None = None, until: float = math.inf, path: str | None = None) -> Result:
    """Try cases in order; one that was tried before is not run again, and one that fails counts as NaN.

    No case starts after the time `until` (time.monotonic); with a path, the driver's, every trial is saved."""
    result = result or Result()
    known = {str(sorted(p.items())): s for p, s in result.trials}
    for p in cases:
        if time.monotonic() >= until:
            break
        key = str(sorted(p.items()))
        if key not in known:
            try:
                known[key] = objective(p)
            except (ValueError, ArithmeticError):
                known[key] = math.nan
        result.trials.append((p, known[key]))
        if path is not None:
            save_trials(path, result)
    return result


def random_search(space: dict[str, Space], objective: Callable[[dict], float], cases: int, seed: int = 42, result: Result | None = None, seconds: float = math.inf, path: str | None = None) -> Result:
    rng = np.random.default_rng(seed)
    return run_cases([{k: s.at(rng.random()) for k, s in space.items()} for _ in range(cases)], objective, result, time.monotonic() + seconds, path)


def bayesian_search(space: dict[str, Space], objective: Callable[[dict], float], cases: int, starts: int = 5, seed: int = 42, candidates: int = 500, seconds: float = math.inf, path: str | None = None) -> Result:
    """Gaussian process with a squared-exponential kernel; the next case has the greatest expected improvement.

    With a path (of the driver) trials are saved there, and an earlier search with the same seed goes on where it stopped: its cases are
    drawn again, but not run."""
    before = load_trials(path) if path is not None else Result()
    done = {str(sorted(p.items())): s for p, s in before.trials}
    until = time.monotonic() + seconds
    rng = np.random.default_rng(seed)
    points = rng.random((min(starts, cases), len(space)))
    case = lambda u: {k: s.at(x) for (k, s), x in zip(space.items(), u)}
    own = objective
    objective = lambda p: done[key] if (key := str(sorted(p.items()))) in done else own(p)
    result = run_cases([case(u) for u in points], objective, None, until, path)
    while starts <= len(result.trials) < cases and time.monotonic() < until:
        y = np.array([s for _, s in result.trials])
        y = np.where(np.isnan(y), np.nanmin(y) if (~np.isnan(y)).any() else 0.0, y)
        scale = y.std() or 1.0
        z = (y - y.mean()) / scale
        kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(axis=2) / (2 * 0.3**2))
        inverse = np.linalg.inv(kernel(points, points) + 1e-4 * np.eye(len(points)))
        new = rng.random((candidates, len(space)))
        cross = kernel(new, points)
        mean = cross @ inverse @ z
        spread = np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", cross, inverse, cross), 1e-12))
        gap = mean - z.max()
        ratio = gap / spread
        improvement = gap * 0.5 * (1 + np.array([math.erf(r / math.sqrt(2)) for r in ratio])) + spread * np.exp(-(ratio**2) / 2) / math.sqrt(2 * math.pi)
        u = new[int(np.argmax(improvement))]
        points = np.concatenate([points, u[None]])
        run_cases([case(u)], objective, result, math.inf, path)
    return result


def search(space: dict[str, Space], fit: Callable[[dict], object], validate: Callable[[object], float], test: Callable[[object], dict] | None = None, cases: int = 20, starts: int = 5, seed: int = 42, seconds: float = math.inf, path: str | None = None) -> dict:
    """Fit, validate and keep the best model of a Bayesian search, then test it: {best, metric, model, test, result}.

    A search that goes on from saved trials fits the best case once more, since models are not saved with them."""
    best: dict = {"metric": -math.inf, "model": None, "best": None}

    def objective(p: dict) -> float:
        model = fit(p)
        value = validate(model)
        if value > best["metric"]:
            best.update(metric=value, model=model, best=p)
        return value

    result = bayesian_search(space, objective, cases, starts, seed, seconds=seconds, path=path)
    if result.trials and not math.isnan(result.best[1]) and result.best[1] > best["metric"]:
        best.update(best=result.best[0], metric=result.best[1], model=fit(result.best[0]))
    return {**best, "test": test(best["model"]) if test is not None and best["model"] is not None else None, "result": result}


def early_stopping(epoch: Callable[[int], None], validate: Callable[[], float], keep: Callable[[], None], most: int, every: int = 1, patience: int = 5, least: int = 0) -> tuple[int, float]:
    """Run epochs until `patience` validations in a row bring no gain; keep() is called at each best. Returns (best epoch, metric)."""
    best, at, worse = -math.inf, 0, 0
    for n in range(1, most + 1):
        epoch(n)
        if n % every and n != most:
            continue
        value = validate()
        if value > best:
            best, at, worse = value, n, 0
            keep()
        else:
            worse += 1
            if worse >= patience and n >= least:
                break
    return at, best
