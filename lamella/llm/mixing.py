"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only.

Token weights are summed by (source, language, topic) cell. Raking scales the cells to each
margin's target shares in turn, round after round, until no margin moves by more than ``tolerance``
(at most ``most_rounds``); a warning tells if shares still move then, or have stopped short of their targets.
A document's probability is its cell's factor, scaled so that the expected tokens are
``budget`` of all tokens; what a probability above 1 cannot give is spread over the other cells, until none of these reaches 1.
A document is drawn if the hash of its id falls below its probability, so a draw is the same on every run.

A margin's target: the given share by value, or the observed share to the power ``temper`` (1: as it is,
0: all alike). Values without a given share get what the given ones leave, in proportion to their tokens.

Edge cases: a null source, language or topic is a value of its own; null and empty texts weigh nothing
and are kept with the probability of their cell; a null id hashes like the text "null"; rows of equal id
share their draw; an empty table gives an empty result; other columns pass through unread.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import stored

MARGINS = ("source", "lang", "topic")
#: From so many cells on, raking runs over shuffled margins; below, in one task of that many small rows.
SMALL = 50_000
ROUNDS_AT_ONCE = 10
#: Shares that miss their targets by more are reported.
MISSED = 1e-6


def topic_of(text: Column) -> Column:
    """A coarse topic from marks in the text."""
    return F.when(text.contains("|"), "table").when(text.contains("="), "code").when(text.rlike("[0-9]"), "figures").otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Token weight: a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / F.lit(4)).cast("long")


def uniform(id_text: Column, seed: int) -> Column:
    """A number in [0, 1) from the md5 of seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_text)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(cells: DataFrame, margin: str, temper: float, given: Mapping[str, float] | None) -> DataFrame:
    """Adds the column t_<margin>: the target share of each cell's value."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("m"))
    if given:
        share = F.coalesce(*[F.when(F.col("value") == k, F.lit(float(v))) for k, v in given.items()])
        rest = max(0.0, 1.0 - sum(given.values()))
        free = sums.agg(F.sum(F.when(share.isNull(), F.col("m")))).first()[0] or 0.0
        target = F.coalesce(share, F.lit(rest) * F.col("m") / F.lit(float(free)) if free else F.lit(0.0))
    else:
        target = F.when(F.col("m") > 0, F.pow("m", F.lit(temper))).otherwise(0.0)
    sums = sums.select("value", target.cast("double").alias("t"))
    total = sums.agg(F.sum("t")).first()[0] or 1.0
    sums = sums.select("value", (F.col("t") / F.lit(float(total))).alias(f"t_{margin}"))
    return cells.join(sums, F.col(margin).eqNullSafe(F.col("value"))).drop("value")


def rake(cells: DataFrame, margins: tuple[str, ...], rounds: int) -> DataFrame:
    """``rounds`` rounds over all margins; w becomes the raked share, moved the largest step of the last round."""
    for r in range(rounds):
        last = r == rounds - 1
        before = F.col("w")
        if last:
            cells = cells.withColumn("before", before)
        for m in margins:
            total = F.sum("w").over(Window.partitionBy(m))
            cells = cells.withColumn("w", F.when(total > 0, F.col("w") * F.col(f"t_{m}") / total).otherwise(0.0))
    return cells.withColumn("moved", F.abs(F.col("w") - F.col("before"))).drop("before")


def cap(cells: DataFrame, want: float) -> DataFrame:
    """Spreads over the open cells what those at 1 leave, until no further cell reaches 1: at most as many passes as cells."""
    full = F.col("p") >= 1.0
    state = [F.count_if(full), F.sum(F.when(full, F.col("tokens")).otherwise(0)).cast("double"), F.sum(F.when(full, 0.0).otherwise(F.col("p") * F.col("tokens")))]
    before, (at, taken, left) = None, cells.agg(*state).first()
    while at != before:
        scale = (want - taken) / left if left else 1.0
        p = F.when(full, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p") * F.lit(float(scale)))))
        cells = stored(cells.withColumn("p", p), "cells")
        before, (at, taken, left) = at, cells.agg(*state).first()
    return cells


def raked_cells(docs: DataFrame, margins: tuple[str, ...] = MARGINS, budget: float = 0.5, temper: float = 0.7, given: Mapping[str, Mapping[str, float]] | None = None, tolerance: float = 1e-9, most_rounds: int = 100) -> DataFrame:
    """(margins..., tokens, w, p) of every cell of a table with the margins and ``tokens``."""
    given = given or {}
    flat = docs.groupBy(*margins).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    cells = stored(flat, "cells")
    small = cells.limit(SMALL + 1).count() <= SMALL
    cells = cells.coalesce(1) if small else cells
    for m in margins:
        cells = targets(cells, m, temper, given.get(m))
    everything = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    cells = cells.withColumn("w", F.col("tokens") / F.lit(everything) if everything else F.lit(0.0))
    cells = cells.coalesce(1) if small else cells
    done = 0
    while True:
        cells = stored(rake(cells, margins, ROUNDS_AT_ONCE), "cells")
        done += ROUNDS_AT_ONCE
        moved = cells.agg(F.max("moved")).first()[0]
        if done >= most_rounds or moved is None or moved <= tolerance:
            break
        cells = cells.coalesce(1) if small else cells
    cells = cells.coalesce(1) if small else cells
    # Margins that contradict each other, or are at odds with empty cells, stop to move unmet.
    missed = cells.select(F.greatest(*[F.abs(F.sum("w").over(Window.partitionBy(m)) - F.col(f"t_{m}")) for m in margins]).alias("missed")).agg(F.max("missed")).first()[0]
    if moved is not None and (moved > tolerance or (missed or 0) > MISSED):
        warnings.warn(f"raking has not converged: after {done} rounds shares move by {moved} and miss their targets by up to {missed}", stacklevel=2)
    # Factors: expected tokens budget * total * w; what capped cells leave is spread over the others.
    want = F.lit(budget * everything)
    cells = cells.withColumn("p", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), want * F.col("w") / F.col("tokens"))).otherwise(0.0))
    cells = cap(cells, budget * everything)
    nothing = F.col("tokens") == 0
    return cells.withColumn("p", F.when(nothing, F.lit(budget)).otherwise(F.col("p"))).select(*margins, "tokens", "docs", "w", "p")


def _drawn(docs: DataFrame, budget: float = 0.5, temper: float = 0.7, given: Mapping[str, Mapping[str, float]] | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, **parameters) -> DataFrame:
    """(row: the columns of ``docs``, mix: source, lang, topic, tokens, p, u, kept)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    tagged = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("id"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("<null>")).alias("source"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("<null>")).alias("lang"),
        F.coalesce(topic if topic is not None else topic_of(text), F.lit("<null>")).alias("topic"), tokens_of(text).alias("tokens"),
    )
    cells = raked_cells(tagged.select(*MARGINS, "tokens"), budget=budget, temper=temper, given=given, **parameters)
    drawn = tagged.join(cells.select(*MARGINS, "p"), list(MARGINS)).withColumn("u", uniform(F.col("id"), seed))
    return drawn.select("row", F.struct(*MARGINS, "tokens", "p", "u", (F.col("u") < F.col("p")).alias("kept")).alias("mix"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """All columns of ``docs`` and mix_source, mix_lang, mix_topic, mix_tokens, mix_p, mix_u, mix_kept, which
    replace columns of these names; ``parameters`` as in ``_drawn``."""
    added = ("source", "lang", "topic", "tokens", "p", "u", "kept")
    own = [c for c in docs.columns if c.lower() not in {f"mix_{x}" for x in added}]
    return _drawn(docs, **parameters).select(*[F.col(f"row.`{c}`") for c in own], *[F.col(f"mix.{x}").alias(f"mix_{x}") for x in added])


def sample(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns as they are, whatever their names."""
    return _drawn(docs, **parameters).where("mix.kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
