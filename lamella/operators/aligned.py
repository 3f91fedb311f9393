"""Multiple alignments and pairwise alignments: similarity, weights, frequencies, positional joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions import sequences as S


def residues(msa: DataFrame, name: str = "name", seq: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each aligned letter: (name, seq_no, pos from 0, aa)."""
    return msa.select(name, "seq_no", *keep, F.posexplode(S.letters(F.col(seq))).alias("pos", "aa"))


def neighbour_weights(msa: DataFrame, mode: str = "a", theta: float = 0.62, name: str = "name", seq: str = "seq", normalise: bool = False) -> DataFrame:
    """(name, seq_no, n, weight): sequences similar to each one, itself included, and 1 / n.

    mode a: equal letters without gaps > theta * own ungapped length; b: mismatches below int((1 - theta) * L);
    c: equal columns with gaps > ceil(theta * L); d: as a, with equality over the shorter ungapped length;
    e: equal letters without gaps and dots >= int(theta * own ungapped length + 0.5).
    Similarity needs equal length, so (name, length) is the join key.
    """
    one = msa.select(name, "seq_no", F.col(seq).alias("s"), F.length(seq).alias("len"), S.ungapped_length(F.col(seq)).alias("full"))
    b = one.select(name, "len", F.col("seq_no").alias("other"), F.col("s").alias("t"), F.col("full").alias("other_full"))
    pair = one.join(b, [name, "len"])
    same = S.matches(F.col("s"), F.col("t"), "-")
    equal = S.matches(F.col("s"), F.col("t"), "")
    if mode == "a":
        hit = same > theta * F.col("full")
    elif mode == "b":
        hit = (F.col("len") - equal) < F.floor((1 - theta) * F.col("len") + 1e-9)
    elif mode == "c":
        hit = equal > F.ceil(theta * F.col("len"))
    elif mode == "d":
        hit = same > theta * F.least("full", "other_full")
    elif mode == "e":
        hit = S.matches(F.col("s"), F.col("t"), "-.") >= F.floor(theta * F.col("full") + 0.5)
    else:
        raise ValueError(f"no mode {mode}")
    hit = hit | (F.col("seq_no") == F.col("other"))
    out = pair.groupBy(name, "seq_no").agg(F.count_if(hit).alias("n")).withColumn("weight", 1.0 / F.col("n"))
    return out.withColumn("weight", F.col("weight") / F.avg("weight").over(Window.partitionBy(name))) if normalise else out


def effective_number(weights: DataFrame, name: str = "name") -> DataFrame:
    return weights.groupBy(name).agg(F.sum("weight").alias("meff"), F.log(F.sum("weight")).alias("ln_meff"))


def self_filter(msa: DataFrame, gaps: float = 0.25, identity: float = 0.9, name: str = "name", seq: str = "seq") -> DataFrame:
    """Rows that are not too gapped and not too like the query (seq_no 0), which stays."""
    query = msa.where("seq_no = 0").select(name, F.col(seq).alias("query"))
    m = msa.join(query, name)
    share = 1 - S.ungapped_length(F.col(seq)) / F.length(seq)
    like = S.matches(F.col(seq), F.col("query")) / F.greatest(S.ungapped_length(F.col(seq)), F.lit(1))
    return m.where((F.col("seq_no") == 0) | ((share <= gaps) & (like <= identity))).drop("query")


def column_frequencies(res: DataFrame, alphabet: str, name: str = "name", weight: str = "w") -> DataFrame:
    """(name, pos, aa, p) with one pseudo-count for each letter: p = (1 + sum w) / (letters + W).

    One shuffle of a row for each column and task: the letters are sums side by side, not rows of a grid. Columns without a letter of ``alphabet`` give none.
    """
    known = res.where(F.col("aa").isin(*alphabet))
    sums = [F.sum(F.when(F.col("aa") == a, F.col(weight)).otherwise(0.0)) for a in alphabet]
    counted = known.groupBy(name, "pos").agg(F.array(*sums).alias("sums"), F.sum(weight).alias("total"))
    cells = counted.select(name, "pos", "total", F.posexplode("sums").alias("place", "s"))
    aa = F.substring(F.lit(alphabet), F.col("place") + 1, F.lit(1))
    return cells.select(name, "pos", aa.alias("aa"), ((1 + F.col("s")) / (len(alphabet) + F.col("total"))).alias("p"))


def pair_frequencies(res: DataFrame, name: str = "name", weight: str = "w", box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(name, i, j, a, b, pab, pa, pb, cov, mi_term) of letter pairs at positions i < j; ``box`` bounds i and j before the join."""
    x, y = res, res
    if box:
        x, y = res.where(F.col("pos").between(box[0], box[1])), res.where(F.col("pos").between(box[2], box[3]))
    left = x.select(name, "seq_no", F.col("pos").alias("i"), F.col("aa").alias("a"), F.col(weight).alias("w"))
    right = y.select(name, "seq_no", F.col("pos").alias("j"), F.col("aa").alias("b"))
    pair = left.join(right, [name, "seq_no"]).where("i < j").groupBy(name, "i", "j", "a", "b").agg(F.sum("w").alias("s"))
    cell = Window.partitionBy(name, "i", "j")
    pab = F.col("s") / F.sum("s").over(cell)
    pa = F.sum("s").over(Window.partitionBy(name, "i", "j", "a")) / F.sum("s").over(cell)
    pb = F.sum("s").over(Window.partitionBy(name, "i", "j", "b")) / F.sum("s").over(cell)
    out = pair.select(name, "i", "j", "a", "b", pab.alias("pab"), pa.alias("pa"), pb.alias("pb"))
    return out.withColumn("cov", F.col("pab") - F.col("pa") * F.col("pb")).withColumn("mi_term", F.col("pab") * F.log(F.col("pab") / (F.col("pa") * F.col("pb"))))


def mutual_information(pairs: DataFrame, name: str = "name") -> DataFrame:
    return pairs.groupBy(name, "i", "j").agg(F.sum("mi_term").alias("mi"))


def column_entropy(freq: DataFrame, base: int = 21, name: str = "name") -> DataFrame:
    return freq.groupBy(name, "pos").agg((-F.sum(F.col("p") * F.log("p")) / F.log(F.lit(float(base)))).alias("entropy"))


def positional_join(ali: DataFrame, keys: list[str], first: str = "t_seq", second: str = "q_seq") -> DataFrame:
    """(keys, col, i, j, a, b): residue numbers from 0 of both sequences in every column; null at gaps."""
    one = ali.select(*keys, F.posexplode(F.arrays_zip(S.letters(F.col(first)).alias("a"), S.letters(F.col(second)).alias("b"))).alias("col", "z")).select(*keys, "col", "z.a", "z.b")
    w = Window.partitionBy(*keys).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda c: F.when(F.col(c) != "-", F.sum((F.col(c) != "-").cast("int")).over(w) - 1)
    return one.select(*keys, "col", at("a").alias("i"), at("b").alias("j"), "a", "b")


def gap_openings(joined: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Gap runs of one side within the columns that both sequences span."""
    span = joined.where("i is not null and j is not null").groupBy(*keys).agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    inside = joined.join(span, keys).where("col between lo and hi")
    w = Window.partitionBy(*keys).orderBy("col")
    gap = F.col(side).isNull()
    return inside.select(*keys, (gap & ~F.coalesce(F.lag(gap).over(w), F.lit(False))).alias("opens")).groupBy(*keys).agg(F.count_if("opens").alias("openings"))


def score_alignment(joined: DataFrame, subst: DataFrame, keys: list[str]) -> DataFrame:
    """Matched columns and the sum of substitution scores; pairs that the table lacks score 0."""
    m = joined.where("i is not null and j is not null").join(subst.select(F.col("aa1").alias("a"), F.col("aa2").alias("b"), "score"), ["a", "b"], "left")
    return m.groupBy(*keys).agg(F.count("*").alias("matched"), F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))


def _best_local(a: str, b: str, match: int, mismatch: int, gap: int) -> int:
    import numpy as np

    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    row, best, steps = np.zeros(len(y) + 1, np.int64), 0, np.arange(len(y) + 1) * gap
    for c in x:
        new = np.zeros(len(y) + 1, np.int64)
        new[1:] = np.maximum(0, np.maximum(row[:-1] + np.where(y == c, match, mismatch), row[1:] + gap))
        row = np.maximum(new, np.maximum.accumulate(new - steps) + steps)  # gaps along the row in one scan
        best = max(best, int(row.max()))
    return best


def local_scores(pairs: DataFrame, a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -2) -> DataFrame:
    """Adds the best local alignment score of two text columns (dynamic programming: Arrow batches)."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pairs.schema.fields)}, score long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.assign(score=[_best_local(x or "", y or "", match, mismatch, gap) for x, y in zip(p[a], p[b], strict=True)])

    return pairs.mapInPandas(run, schema)


def contained(whole: DataFrame, part: DataFrame, key: str, text: str, sub: str) -> DataFrame:
    """Pairs of rows where the part's text lies in the whole's, with its place from 1.

    Three inner words of a part, the longest such stretch, must stand in the whole word for word, so that stretch is the join key;
    what it brings together is compared. Only parts of fewer than five words are compared with every whole: they are to be few."""
    def cut(c: str) -> Column:
        return F.explode(F.array(F.split(c, " ")))  # a generator, so that the words are not split anew for each stretch

    three = lambda i: F.array_join(F.slice("w", i, 3), " ")
    parts = part.select(sub).where(F.col(sub).isNotNull()).distinct().select(sub, cut(sub).alias("w"))
    best = F.array_max(F.transform(F.sequence(F.lit(2), F.size("w") - 3), lambda i: F.struct(F.length(three(i)).alias("n"), three(i).alias("a"))))
    anchored = parts.where(F.size("w") >= 5).select(sub, best["a"].alias("a"))
    own = whole.select(key, cut(text).alias("w")).where(F.size("w") >= 3)
    own = own.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 2), three))).alias("a"))
    near = own.join(anchored, "a").select(F.col(key).alias("__near"), sub).distinct()
    rows = whole.select(F.struct("*").alias("__row"), F.col(key).alias("__key"), F.col(text).alias("__text"))
    hit = rows.join(near, F.col("__key").eqNullSafe(F.col("__near"))).select("__row", "__text", sub)
    few = rows.join(parts.where(F.size("w") < 5).select(sub), F.expr(f"locate({sub}, __text) > 0")).select("__row", "__text", sub)
    found = hit.unionAll(few).withColumn("at", F.expr(f"locate({sub}, __text)")).where("at > 0")
    return found.join(part, sub).select("__row.*", *part.columns, "at")


def split_contained(whole: str, sub: str) -> Column:
    """Smallest cut of ``sub`` whose two pieces lie in ``whole`` in order; null if none does."""
    cut = f"transform(sequence(1, length({sub}) - 1), m -> struct(m as m, locate(substring({sub}, 1, m), {whole}) as p))"
    ok = f"filter({cut}, x -> x.p > 0 and locate(substring({sub}, x.m + 1), {whole}, x.p + x.m) > 0)"
    return F.expr(f"case when length({sub}) > 1 and size({ok}) > 0 then {ok}[0].m end")
