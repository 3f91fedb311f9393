"""Profile transforms: normalised emissions, pseudo-counts, smoothed transitions, scores against the background."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values. Transitions in file order (M to M, I, D; I to M, I; D to M, D): the effective number that weighs each, and its prior.
SOURCE = (0, 0, 0, 1, 1, 2, 2)
PRIOR = (0.6, 0.2, 0.2, 0.25, 0.75, 0.25, 0.75)
#: Weight of the priors, and of the pseudo-counts.
PRIOR_WEIGHT, PSEUDO = 0.1, 10.0


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def normalised(emission: Column, aa: Column, letters: str) -> Column:
    """Emissions that sum to 1; the residue's own letter alone where all are 0."""
    own = F.array(*[(aa == c).cast("double") for c in letters])
    return F.when(_sum(emission) > 0, F.transform(emission, lambda x: x / _sum(emission))).otherwise(own)


def smoothed_transitions(transition: Column) -> Column:
    """The seven transitions, each drawn to its prior as its effective number is small."""
    one = []
    for i, (source, prior) in enumerate(zip(SOURCE, PRIOR, strict=True)):
        n = transition[7 + source]
        one.append((n * transition[i] + PRIOR_WEIGHT * prior) / (PRIOR_WEIGHT + n))
    return F.array(*one)


def with_pseudo_counts(p: Column, effective: Column, background: Column, substitution: Sequence[Sequence[float]]) -> Column:
    """Emissions mixed with what the substitution table expects: ((n - 1) p + 10 g) / (n + 9), where g is the
    normalised sum over letters of p times the table's row times the background 2 ** (-x / 1000)."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in column]) for column in zip(*substitution, strict=True)])
    raw = F.zip_with(rows, background, lambda row, x: _sum(F.zip_with(p, row, lambda a, b: a * b)) * F.pow(F.lit(2.0), -x / 1000))
    g = F.transform(raw, lambda x: x / _sum(raw))
    return F.zip_with(p, g, lambda a, b: ((effective - 1) * a + PSEUDO * b) / (effective - 1 + PSEUDO))


def transformed(profiles: DataFrame, substitution: Sequence[Sequence[float]], letters: str = "ACDEFGHIKLMNPQRSTVWY") -> DataFrame:
    """``profiles`` (see the reader) with frequency[20] after pseudo-counts, score[20] in bits against the background, and
    the seven smoothed transitions; the table's rows and columns are in the order of ``letters``."""
    p = profiles.withColumn("p", normalised(F.col("emission"), F.col("aa"), letters))
    p = p.withColumn("frequency", with_pseudo_counts(F.col("p"), F.col("transition")[7], F.col("background"), substitution)).drop("p")
    score = F.zip_with("frequency", "background", lambda f, x: F.log2(f) + x / 1000)
    return p.withColumn("score", score).withColumn("smoothed", smoothed_transitions(F.col("transition")))
