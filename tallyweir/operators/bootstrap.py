"""Parametric bootstrap of stratified population estimates, for fits whose information matrix gives no standard error.

Every replicate is a closed population of the fitted size: of the N(g) animals of a pool a binomial number is marked,
marked and unmarked animals are seen in the weeks with the fitted probabilities, and the counts are fitted anew. The
limits are order statistics of the replicates' estimates.

Replicates of all groups are rows of one table and are refitted beside each other, in batches that repeat the fit of
the data once. The random numbers of a replicate depend on the seed, the group and its number only, so a lost task gives the same rows again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.operators.stratified import fit_pools, join_empty_weeks, pooled_counts

REPLICATES = 200
#: Replicates that one group of a batch refits.
BATCH = 10
LEVEL = 0.95


def estimate(m: np.ndarray, u: np.ndarray, released: np.ndarray):
    """(N, odds, theta) of pooled counts, or None without a converged fit."""
    m, u = join_empty_weeks(m, u)
    if not len(m) or not (m.sum(axis=1) > 0).all() or u.sum() <= 0:
        return None
    beta, theta, converged = fit_pools(m, u)
    return (float(((1.0 + beta) * released).sum()), beta, theta) if converged else None


def replicate(rng: np.random.Generator, beta: np.ndarray, theta: np.ndarray, released: np.ndarray):
    """Counts (m, u, released) of a closed population with the fitted odds and weekly probabilities."""
    seen = theta / released[:, None]
    seen = seen / np.maximum(seen.sum(axis=1, keepdims=True), 1.0)  # more recoveries than releases: all are seen
    size = np.round((1.0 + beta) * released).astype(np.int64)
    marked = rng.binomial(size, 1.0 / (1.0 + beta))
    chances = np.column_stack([seen, np.maximum(1.0 - seen.sum(axis=1), 0.0)])
    chances = chances / chances.sum(axis=1, keepdims=True)
    m = np.array([rng.multinomial(n, p)[:-1] for n, p in zip(marked, chances, strict=True)], float)
    u = np.sum([rng.multinomial(n, p)[:-1] for n, p in zip(size - marked, chances, strict=True)], axis=0).astype(float)
    return m, u, marked.astype(float)


def abundance_intervals(
    cells: DataFrame, keys: Sequence[str] = (), replicates: int = REPLICATES, seed: int = 1, level: float = LEVEL
) -> DataFrame:
    """Per group: n_hat, boundary, lower, upper, spread (standard deviation of the replicates), refitted (replicates with a fit).

    ``cells`` are rows (keys, model_id, kind, row, col, pool, n). A group without a converged fit has NULL limits.
    """
    by = [*keys, "model_id"]
    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in by) + ", batch INT, replicate INT, n_hat DOUBLE, boundary BOOLEAN, estimate DOUBLE"
    columns = [*by, "batch", "replicate", "n_hat", "boundary", "estimate"]

    def refit(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        m, u, released = pooled_counts(pdf)
        base = estimate(m, u, released)
        if base is None:
            return pd.DataFrame([[*group, None, None, None, None]], columns=columns)
        n_hat, beta, theta = base
        name = "\x1f".join(map(str, group[:-1]))
        number = int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little")
        rows = []
        for k in range(group[-1] * BATCH, min((group[-1] + 1) * BATCH, replicates)):
            rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, number, k])))
            again = estimate(*replicate(rng, beta, theta, released))
            rows.append([*group, k, n_hat, bool((beta < 1e-6).any()), again[0] if again else None])
        return pd.DataFrame(rows, columns=columns)

    batches = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(replicates / BATCH) - 1))).alias("batch")
    spread = cells.select("*", batches)
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = spread.repartition(4 * parts, *by, "batch").groupBy(*by, "batch").applyInPandas(refit, schema)
    ordered = fits.groupBy(*by).agg(
        F.max("n_hat").alias("n_hat"), F.max("boundary").alias("boundary"), F.stddev_samp("estimate").alias("spread"),
        F.count("estimate").cast("int").alias("refitted"), F.array_sort(F.collect_list("estimate")).alias("_sorted"),
    )
    tail = (1.0 - level) / 2.0

    def at(share: float, up: bool):
        place = F.greatest(F.lit(1), F.ceil(F.lit(share) * (F.size("_sorted") + 1)) if up else F.floor(F.lit(share) * (F.size("_sorted") + 1)))
        return F.get("_sorted", (F.least(place, F.size("_sorted")) - 1).cast("int"))

    return ordered.select(*by, "n_hat", "boundary", at(tail, False).alias("lower"), at(1 - tail, True).alias("upper"), "spread", "refitted")
