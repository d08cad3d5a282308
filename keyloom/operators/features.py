"""Feature extraction: a schema of features, and one float vector for each row."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.frame import KeyedFrame, quoted


@dataclass
class Continuous:
    """Standardised number: (x - mean) / standard deviation."""

    mean: float | None = None
    std: float | None = None
    width = 1

    def encode(self, c: Column) -> list[Column]:
        scale = self.std if self.std else 1.0
        return [(c.cast("double") - F.lit(self.mean or 0.0)) / F.lit(scale)]


@dataclass
class Categorical:
    """One column for each label, in sorted order; an unknown label is an error."""

    labels: list = field(default_factory=list)

    @property
    def width(self) -> int:
        return len(self.labels)

    def encode(self, c: Column) -> list[Column]:
        known = c.isNull() | c.isin(*self.labels) if self.labels else F.lit(True)
        checked = F.when(known, F.lit(0.0)).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), c.cast("string"))).cast("double"))
        out = [F.when(c == F.lit(x), 1.0).otherwise(0.0) for x in self.labels]
        return [out[0] + checked, *out[1:]] if out else []


@dataclass
class Maybe:
    """A flag for missing, then the inner feature (zeros where missing)."""

    feature: Any

    @property
    def width(self) -> int:
        return self.feature.width + 1

    def encode(self, c: Column) -> list[Column]:
        missing = c.isNull()
        return [missing.cast("double"), *[F.when(missing, 0.0).otherwise(e) for e in self.feature.encode(c)]]


MAX_LABELS = 10_000  # a categorical column with more labels is refused: its vectors would be wider


def schema(t: KeyedFrame, hints: dict[str, Any] | None = None) -> dict[str, Any]:
    """The feature of each column, in table order.

    Numbers are continuous, columns with missing values get ``Maybe``, others are left out unless
    ``hints`` names a feature; a hint of None leaves a column out.  One aggregate pass gives all
    statistics; labels are counted with another.
    """
    hints = hints or {}
    unknown = [h for h in hints if h not in t.columns]
    if unknown:
        raise KeyError(f"no columns {unknown}")
    kinds: dict[str, Any] = {}
    for f in t.schema.fields:
        if f.name in hints:
            if hints[f.name] is not None:
                kinds[f.name] = hints[f.name]
        elif isinstance(f.dataType, T.NumericType):
            kinds[f.name] = Continuous
    if not kinds:
        return {}
    cols = []
    for i, c in enumerate(kinds):
        cols.append(F.count_if(quoted(c).isNull()).alias(f"m{i}"))
        if _base(kinds[c]) is Continuous:
            cols += [F.avg(quoted(c).cast("double")).alias(f"a{i}"), F.stddev_samp(quoted(c).cast("double")).alias(f"s{i}")]
    stats = t.df.agg(*cols).first()
    out: dict[str, Any] = {}
    for i, (c, kind) in enumerate(kinds.items()):
        if not isinstance(kind, type):
            out[c] = kind
            continue
        if _base(kind) is Continuous:
            feature: Any = Continuous(stats[f"a{i}"], stats[f"s{i}"])
        else:
            labels = t.df.where(quoted(c).isNotNull()).select(quoted(c).alias("v")).distinct().orderBy("v").limit(MAX_LABELS + 1).collect()
            if len(labels) > MAX_LABELS:
                raise ValueError(f"{c!r} has more than {MAX_LABELS} labels")
            feature = Categorical([r["v"] for r in labels])
        out[c] = Maybe(feature) if stats[f"m{i}"] or kind is Maybe else feature
    return out


def _base(kind: Any) -> Any:
    return Continuous if kind in (Continuous, Maybe) or isinstance(kind, Continuous) else Categorical


def width(features: dict[str, Any]) -> int:
    return sum(f.width for f in features.values())


def splitschema(features: dict[str, Any], *names: str) -> tuple[dict[str, Any], dict[str, Any]]:
    """(the rest, the named features)."""
    return {k: v for k, v in features.items() if k not in names}, {k: features[k] for k in names}


def featuremat(t: KeyedFrame, features: dict[str, Any] | None = None, name: str = "features") -> DataFrame:
    """The table with an ``array<float>`` column of all features (one vector a row)."""
    features = schema(t) if features is None else features
    cells = [e.cast("float") for c, f in features.items() for e in f.encode(quoted(c))]
    return t.df.withColumn(name, F.array(*cells) if cells else F.array().cast("array<float>"))
