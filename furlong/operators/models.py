"""Conditional logit, power recalibration and the market combination."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.operators import scoring

#: The range of the market's power and the least probability that counts.
LOW, HIGH = 0.5, 2.0
TINY = 1e-12


@dataclass
class Choice:
    """A conditional logit to fit: its columns, their scales, the penalty, and its rows, of all days or of [first, end) and of one ``key`` or all."""

    columns: list[str]
    l2: float = 1.0
    scale: np.ndarray | None = None
    first: dt.date | None = None
    end: dt.date | None = None
    key: int | None = None
    beta: np.ndarray = field(init=False)
    step: np.ndarray = field(init=False)
    best: float = field(init=False, default=-np.inf)
    done: bool = field(init=False, default=False)

    def __post_init__(self) -> None:
        self.beta, self.step = np.zeros(len(self.columns)), np.zeros(len(self.columns))
        self.scale = np.ones(len(self.columns)) if self.scale is None else np.asarray(self.scale, dtype=float)

    def sums(self, x: np.ndarray, won: np.ndarray, code: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood, gradient and negative Hessian of whole races at the next coefficients; code: races by number, in order, from 0 without gaps."""
        n, x = code[-1] + 1, x / self.scale
        v = x @ (self.beta + self.step)
        top = np.maximum.reduceat(v, np.flatnonzero(np.append(True, np.diff(code) > 0)))
        e = np.exp(v - top[code])
        total = np.bincount(code, e, n)
        p = e / total[code]
        mean = np.stack([np.bincount(code, p * x[:, i], n) for i in range(x.shape[1])], axis=1)
        return float((won * (v - top[code])).sum() - np.log(total).sum()), (won - p) @ x, (x * p[:, None]).T @ x - mean.T @ mean

    def move(self, value: float, g: np.ndarray, h: np.ndarray) -> None:
        """A Newton step, or half of the one before where it went too far."""
        now = self.beta + self.step
        value -= self.l2 / 2 * float(now @ now)
        if value < self.best:
            self.step = self.step / 2
            self.done = np.abs(self.step).max() < 1e-12
            return
        self.beta, self.best = now, value
        self.step = np.linalg.lstsq(h + self.l2 * np.eye(len(g)), g - self.l2 * now, rcond=None)[0]
        self.done = np.abs(self.step).max() < 1e-9


def fit_choices(df: DataFrame, choices: list[Choice], race: str = "race_id", y: str = "y", date: str = "date", key: str | None = None, steps: int = 40) -> None:
    """Fits all ``choices`` together: each maximises the winners' likelihood minus l2 / 2 * |beta|^2, by Newton steps.

    Each pass over the rows adds up likelihood, gradient and Hessian of every fit that still moves, whatever their rows; tasks hold whole races and send
    a row of sums for each fit. So many fits over growing parts of one history cost the passes of one. Races without exactly one winner must be left out before.
    """
    names = sorted({c for x in choices for c in x.columns})
    dated = any(x.first or x.end for x in choices)
    by = [F.col(race), *([F.col(key)] if key else [])]
    own = [*by, F.col(y).cast("double").alias("y"), *([F.unix_date(date).alias("day")] if dated else []), *[F.col(c).cast("double") for c in names]]
    data = df.select(*own).repartition(*by).sortWithinPartitions(*by).persist(StorageLevel.MEMORY_AND_DISK)
    epoch = dt.date(1970, 1, 1)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [p for p in parts if len(p)]
        if not rows:
            return
        pdf = pd.concat(rows)
        ids = pdf[race].to_numpy()
        new = ids[1:] != ids[:-1]
        if key:
            new = new | (pdf[key].to_numpy()[1:] != pdf[key].to_numpy()[:-1])
        code, out = np.concatenate(([0], np.cumsum(new))), []
        for i, c in enumerate(choices):
            if c.done:
                continue
            use = np.ones(len(pdf), dtype=bool)
            if c.first:
                use &= pdf["day"].to_numpy() >= (c.first - epoch).days
            if c.end:
                use &= pdf["day"].to_numpy() < (c.end - epoch).days
            if key and c.key is not None:
                use &= pdf[key].to_numpy() == c.key
            if use.any():
                races = np.cumsum(np.append(0, np.diff(code[use]) > 0))
                value, g, h = c.sums(pdf[c.columns].to_numpy(float)[use], pdf["y"].to_numpy()[use], races)
                out.append((i, value, g.tolist(), h.ravel().tolist()))
        yield pd.DataFrame(out, columns=["i", "value", "g", "h"])

    try:
        for _ in range(steps):
            if all(c.done for c in choices):
                break
            got = data.mapInPandas(run, "i int, value double, g array<double>, h array<double>").collect()  # a row a fit and task
            for i, c in enumerate(choices):
                held = [r for r in got if r.i == i]
                if held:
                    k = len(c.columns)
                    c.move(sum(r.value for r in held), np.sum([r.g for r in held], axis=0), np.sum([r.h for r in held], axis=0).reshape(k, k))
                elif not c.done:
                    c.done = True  # no rows: coefficients stay 0
    finally:
        data.unpersist()


def fit_conditional_logit(df: DataFrame, features: list[str], race: str = "race_id", y: str = "y", l2: float = 1.0, steps: int = 40) -> np.ndarray:
    """Coefficients of one conditional logit (``fit_choices``)."""
    choice = Choice(features, l2)
    fit_choices(df, [choice], race, y, steps=steps)
    return choice.beta


def power_choice(column: str, **rows) -> Choice:
    """The power of the market as a choice: p to the power a, as shares of the race, is the softmax of a * ln p."""
    return Choice([column], 0.0, **rows)


def power_of(choice: Choice) -> float:
    """The fitted power within [LOW, HIGH]; the loss is convex in it, so a limit is best where the optimum lies beyond."""
    return float(np.clip(choice.beta[0], LOW, HIGH))


def fit_power(df: DataFrame, race: str = "race_id", p: str = "p", y: str = "y") -> float:
    """The exponent in [LOW, HIGH] with the least mean log loss; probabilities below TINY count as TINY."""
    choice = power_choice("ln_p")
    fit_choices(df.select(race, y, F.log(scoring.clipped(F.col(p), TINY)).alias("ln_p")), [choice], race, y)
    return power_of(choice)
