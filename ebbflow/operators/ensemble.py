"""Ensembles over out-of-fold predictions (M5): greedy selection with replacement and a second level.

Selection starts from nothing and adds, round after round, the candidate that brings the
mean of all picked so far closest to the target by WMAPE; a candidate may be picked again, so
the picks are weights.  One aggregate a round scores every candidate: the picked sum
is an expression of the prediction columns, no row is copied or rewritten, and the
cost is rounds x candidates, where a weight grid grows with its binomial.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.operators import normal_eq as NE
from ebbflow.schema import D, K
from ebbflow.session import cut_lineage

ROUNDS = 25
#: Digits in which a round has to be better than the best before it.
DIGITS = 10
SELECTION = "model string, picks int, weight double, wmape double"


def picked_sum(picks: dict[str, int]):
    return sum((F.lit(float(n)) * F.col(c) for c, n in picks.items() if n), F.lit(0.0))


def select_ensemble(oof: DataFrame, target: str, candidates: list[str], rounds: int = ROUNDS) -> tuple[dict[str, int], float]:
    """(picks of each candidate, WMAPE of their mean) of the best round; the first candidate, and the fewest picks, on ties.

    Rows that lack the target or a candidate's prediction are left out.
    """
    rows = oof.select(target, *candidates).na.drop("any")
    picks = dict.fromkeys(candidates, 0)
    best: tuple[dict[str, int], float] = (dict(picks), float("inf"))
    for k in range(1, rounds + 1):
        errors = [F.sum(F.abs(F.col(target) - (picked_sum(picks) + F.col(c)) / F.lit(float(k)))).alias(f"e{i}") for i, c in enumerate(candidates)]
        got = rows.agg(F.sum(F.abs(target)).alias("all"), *errors).first()
        if not got["all"]:
            return best
        scores = [got[f"e{i}"] / got["all"] for i in range(len(candidates))]
        chosen = min(range(len(candidates)), key=scores.__getitem__)
        picks[candidates[chosen]] += 1
        if round(scores[chosen], DIGITS) < round(best[1], DIGITS):
            best = (dict(picks), scores[chosen])
    return best


def selection_table(oof: DataFrame, target: str, candidates: list[str], rounds: int = ROUNDS) -> DataFrame:
    """model, picks, weight, and the WMAPE of the ensemble."""
    picks, score = select_ensemble(oof, target, candidates, rounds)
    all_ = sum(picks.values()) or 1
    rows = [(c, n, n / all_, score if all_ else None) for c, n in picks.items()]
    return oof.sparkSession.createDataFrame(rows, SELECTION)


def blended(df: DataFrame, picks: dict[str, int], out: str) -> DataFrame:
    """Adds the mean of the picks."""
    return df.withColumn(out, picked_sum(picks) / F.lit(float(sum(picks.values()) or 1)))


def stacked(df: DataFrame, groups: dict[str, list[str]], target: str, block, k: int = 5, l2: float = NE.RIDGE,
            rounds: int = ROUNDS) -> tuple[DataFrame, dict[str, int]]:
    """M5: base models of each feature group, a second level on their out-of-fold columns, and the selection among all.

    Blocks are runs of days: a base prediction comes from earlier blocks, the second level (``l2``
    column) from base predictions of blocks before its own.  Returns key, date, target, the base
    columns, ``level2`` and ``ensemble`` for blocks 2 to k - 1, and the picks.
    """
    rows = df.withColumn("__block", block.cast("long"))
    level1, base = rows.select(K, D, target, "__block"), [f"base_{name}" for name in groups]
    for out, features in zip(base, groups.values(), strict=True):
        oof = NE.time_blocked(rows, features, target, F.col("__block"), k, l2, out)
        level1 = level1.join(oof.select(K, D, out), [K, D])
    level1 = cut_lineage(level1)  # every round of the selection reads them
    level2 = NE.time_blocked(level1, base, target, F.col("__block"), k, l2, out="level2").where("__block >= 2")
    level2 = cut_lineage(level2)
    picks, _ = select_ensemble(level2, target, [*base, "level2"], rounds)
    return blended(level2, picks, "ensemble").drop("__block"), picks
