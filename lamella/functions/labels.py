"""The small language of responses, labels and feature switches, and the columns that it selects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of a response and the numbers of values and of parameters that each has (fixed values).
VALUES = {"Normal": 1, "Normal2d": 2, "Normal2d2": 2, "Normal2d4": 2, "LogNormal": 1, "LogNormal2d": 2, "LogNormal2d2": 2, "LogNormal2d4": 2}
PARAMETERS = {"Normal": 2, "Normal2d": 5, "Normal2d2": 2, "Normal2d4": 4, "LogNormal": 2, "LogNormal2d": 5, "LogNormal2d2": 2, "LogNormal2d4": 4}
#: What the bits of a coupling switch select, from the lowest on (fixed values).
COUPLING_BITS = ("fnorm", "sum", "raw", "mutual_information", "covariance")


def response(c: Column, labels: Mapping[str, int] | None = None) -> Column:
    """Struct of name, kind, sub, values and parameters of "Name_KindSub"; null where the kind is none of Discrete, Normal, LogNormal.
    ``labels``: number of classes by sub kind of a discrete response."""
    name, kind = F.get(F.split(c, "_"), 0), F.get(F.split(c, "_"), 1)
    sub = F.regexp_extract(kind, "^(Discrete|LogNormal|Normal)(.*)$", 2)
    known = F.coalesce(kind.rlike("^(Discrete|LogNormal|Normal)"), F.lit(False))
    look = lambda table, key: F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()])
    discrete = kind.startswith("Discrete")
    values = F.when(discrete, F.lit(1)).otherwise(look(VALUES, kind))
    parameters = F.when(discrete, look(labels, sub) if labels else F.lit(None).cast("int")).otherwise(look(PARAMETERS, kind))
    return F.when(known, F.struct(name.alias("name"), kind.alias("kind"), sub.alias("sub"), values.alias("values"), parameters.alias("parameters")))


def label_names(text: str, known: Sequence[str], groups: Mapping[str, Sequence[str]]) -> list[str]:
    """Names of "A+B+Group": groups stand for their members, whatever their case; an unknown name is an error."""
    by_name, out = {k.upper(): v for k, v in groups.items()}, []
    for part in text.split("+"):
        if part.upper() in by_name:
            out += by_name[part.upper()]
        elif part in known:
            out.append(part)
        else:
            raise ValueError(f"no label {part} (in {text})")
    return out


def coupling_switches(mode: Column) -> Column:
    """Struct of booleans, one for each bit."""
    return F.struct(*[(mode.bitwiseAND(F.lit(1 << i)) > 0).alias(n) for i, n in enumerate(COUPLING_BITS)])


def layers(text: Column) -> Column:
    """Numbers of "3,5t8 12": single ones and ranges, both ends included."""
    part = F.filter(F.split(text, "[, ]"), lambda x: x != "")
    one = F.transform(part, lambda x: F.sequence(F.get(F.split(x, "t"), 0).cast("int"), F.element_at(F.split(x, "t"), -1).cast("int")))
    return F.flatten(one)


def features(df: DataFrame, keys: Sequence[str], switches: Mapping[str, bool], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """(keys, x): the columns of the features that are switched on, in order, in one array. Array columns are joined, numbers become one element."""
    kinds = dict(df.dtypes)
    chosen = [c for feature, own in columns.items() if switches.get(feature) for c in own]
    missing = [c for c in chosen if c not in kinds]
    if missing:
        raise ValueError(f"switched on but absent: {', '.join(missing)}")
    one = [F.col(c).cast("array<double>") if kinds[c].startswith("array") else F.array(F.col(c).cast("double")) for c in chosen]
    return df.select(*keys, (F.concat(*one) if one else F.array().cast("array<double>")).alias("x"))


def labels(df: DataFrame, keys: Sequence[str], edges: Mapping[str, Sequence[float]], logs: Sequence[str] = ()) -> DataFrame:
    """(keys, response, label): one row for each response column. A column in ``edges`` becomes the number of its bin, one in ``logs`` its logarithm."""
    own = [c for c in df.columns if c not in keys]

    def value(c: str) -> Column:
        v = F.col(c).cast("double")
        if c in edges:
            return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[c]]), lambda e: e <= v)).cast("double") - 1
        return F.log(F.greatest(v, F.lit(1e-12))) if c in logs else v

    each = F.array(*[F.struct(F.lit(c).alias("response"), value(c).alias("label")) for c in own])
    return df.select(*keys, F.inline(each))
