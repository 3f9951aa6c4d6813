"""A list of column transformers, fitted in order from few scans.

The list holds (name, transformer, kind): each transformer works on the discrete or on the numeric features, after those before it in the list;
the output vector has the discrete features first. Fitting needs statistics of every step's input, that is of the data as the earlier steps
left it. Scaling is increasing and affine and filling puts one value in the place of the missing ones, so those statistics follow in closed form from the raw ones:
the planner asks every transformer what it needs, reads the moments of all features in one scan and the most frequent values in one
more (only for features that need them), and derives the rest. Where a statistic can't be derived (the most frequent value after filling by another one),
the features concerned are read again at that step, together.

``ColumnTransformers`` is an Estimator, its model one native projection; both persist with the standard ML writers.
"""

from __future__ import annotations

import enum
import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark.functions import nan_to_null, q, split_discrete_numeric
from ctxspark.operators.stats import column_modes, column_moments


class Kind(str, enum.Enum):
    DISCRETE = "discrete"
    NUMERIC = "numeric"


@dataclass(frozen=True)
class Stats:
    """Statistics of a feature as a step sees it. ``mode`` is None where it isn't known, ``mean`` and the rest None without any value."""

    rows: int
    n: int
    mean: float | None
    m2: float | None           # sum of squared deviations
    low: float | None
    high: float | None
    mode: float | None = None

    def scaled(self, shift: float, scale: float) -> "Stats":
        f = lambda v: None if v is None else (v - shift) / scale
        m2 = None if self.m2 is None else self.m2 / (scale * scale)
        return replace(self, mean=f(self.mean), m2=m2, low=f(self.low), high=f(self.high), mode=f(self.mode))

    def filled(self, value: float) -> "Stats":
        z = self.rows - self.n
        if not z:
            return self
        if not self.n:
            return Stats(self.rows, self.rows, value, 0.0, value, value, value)
        mean = (self.n * self.mean + z * value) / self.rows
        m2 = self.m2 + self.n * (self.mean - mean) ** 2 + z * (value - mean) ** 2
        return Stats(self.rows, self.rows, mean, m2, min(self.low, value), max(self.high, value), self.mode if self.mode == value else None)


@dataclass(frozen=True)
class Transformer:
    """``needs_mode``: whether fitting asks for the most frequent value; ``fit`` gives a step (operation, numbers), None to drop the feature."""

    @property
    def needs_mode(self) -> bool:
        return False

    def fit(self, s: Stats) -> tuple | None:
        raise NotImplementedError


@dataclass(frozen=True)
class StandardScale(Transformer):
    """(x - mean) / population standard deviation, 1 for a constant feature."""

    def fit(self, s: Stats) -> tuple | None:
        return ("scale", s.mean, math.sqrt(s.m2 / s.n) or 1.0) if s.n else ("scale", 0.0, 1.0)


@dataclass(frozen=True)
class MinMaxScale(Transformer):
    """(x - least) / (greatest - least), divided by 1 for a constant feature."""

    def fit(self, s: Stats) -> tuple | None:
        return ("scale", s.low, (s.high - s.low) or 1.0) if s.n else ("scale", 0.0, 1.0)


@dataclass(frozen=True)
class Impute(Transformer):
    """Missing values by ``strategy``: "most_frequent" (ties: the smallest), "mean" or "constant". A feature without any value is
    dropped, unless the fill is a constant."""

    strategy: str = "most_frequent"
    value: float = 0.0

    def __post_init__(self):
        if self.strategy not in ("most_frequent", "mean", "constant"):
            raise ValueError(f"unknown strategy {self.strategy!r}")

    @property
    def needs_mode(self) -> bool:
        return self.strategy == "most_frequent"

    def fit(self, s: Stats) -> tuple | None:
        if self.strategy == "constant":
            return "fill", float(self.value)
        return ("fill", s.mode if self.needs_mode else s.mean) if s.n else None


KINDS = {c.__name__: c for c in (StandardScale, MinMaxScale, Impute)}

#: The preparation of the reference: scale the numeric features, then fill both kinds by the most frequent value.
DEFAULT = (("scaler", StandardScale(), Kind.NUMERIC), ("imputer_discrete", Impute(), Kind.DISCRETE), ("imputer_numeric", Impute(), Kind.NUMERIC))


def checked(transformers: Sequence[tuple]) -> list[tuple[str, Transformer, Kind]]:
    """The list, or an error: every entry needs a transformer of this module and a kind of column."""
    out = []
    for entry in transformers:
        name, transformer, kind = entry
        if not isinstance(transformer, Transformer):
            raise TypeError(f"{name}: {transformer!r} is not a Transformer")
        if not isinstance(kind, Kind):
            raise ValueError(f"{name}: {kind!r} is not a kind of column, use Kind.DISCRETE or Kind.NUMERIC")
        out.append((str(name), transformer, kind))
    return out


def apply_steps(x: Column, steps: Sequence[Sequence]) -> Column:
    for step in steps:
        x = F.coalesce(x, F.lit(step[1])) if step[0] == "fill" else (x - F.lit(step[1])) / F.lit(step[2])
    return x


def raw_statistics(df: DataFrame, features: Sequence[str], with_mode: Sequence[str]) -> dict[str, Stats]:
    """Moments and extremes of ``features`` in one scan, most frequent values of ``with_mode`` in one more."""
    moments = column_moments(df, features, extremes=True).collect()
    rows = max((r["rows"] for r in moments), default=0)
    modes = {r["feature"]: r["mode"] for r in column_modes(df, with_mode, rows).collect()} if with_mode else {}
    out = {}
    for r in moments:
        m2 = None if r["std"] is None else r["std"] ** 2 * r["n"]
        out[r["feature"]] = Stats(r["rows"], r["n"], r["mean"], m2, r["low"], r["high"], modes.get(r["feature"]))
    return out


def fit_plan(df: DataFrame, features: Sequence[str], transformers: Sequence[tuple]) -> dict[str, list]:
    """{feature: steps} of the features that stay, in the order of ``features``."""
    transformers = checked(transformers)
    discrete, numeric = split_discrete_numeric(features)
    of = {Kind.DISCRETE: list(discrete), Kind.NUMERIC: list(numeric)}
    first_mode = [c for kind in Kind if any(t.needs_mode for _, t, k in transformers if k is kind) for c in of[kind]]
    stats = raw_statistics(df, list(features), first_mode)
    steps: dict[str, list] = {c: [] for c in features}
    for _, transformer, kind in transformers:
        live = [c for c in of[kind] if c in steps]
        if transformer.needs_mode:
            unknown = [c for c in live if stats[c].mode is None and stats[c].n]
            if unknown:
                seen = df.select(*[apply_steps(nan_to_null(q(c).cast("double")), steps[c]).alias(c) for c in unknown])
                modes = {r["feature"]: r["mode"] for r in column_modes(seen, unknown, stats[unknown[0]].rows).collect()}
                stats |= {c: replace(stats[c], mode=modes[c]) for c in unknown}
        for c in live:
            step = transformer.fit(stats[c])
            if step is None:
                del steps[c]
                continue
            steps[c].append(list(step))
            stats[c] = stats[c].filled(step[1]) if step[0] == "fill" else stats[c].scaled(*step[1:])
    return steps


def to_json(transformers: Sequence[tuple]) -> str:
    return json.dumps([[name, type(t).__name__, asdict(t), kind.value] for name, t, kind in checked(transformers)])


def from_json(text: str) -> list[tuple[str, Transformer, Kind]]:
    return [(name, KINDS[cls](**params), Kind(kind)) for name, cls, params, kind in json.loads(text)]


class ColumnTransformers(Estimator, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of a list of transformers over ``inputCols``."""

    transformers = Param(Params._dummy(), "transformers", "the list as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCol: str = "features", transformers: str = to_json(DEFAULT)):
        super().__init__()
        self._setDefault(outputCol="features", transformers=to_json(DEFAULT))
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "ColumnTransformersModel":
        features = list(self.getInputCols())
        missing = [c for c in features if c not in dataset.columns]
        if missing:
            raise ValueError(f"columns not in the data: {missing}")
        steps = fit_plan(dataset, features, from_json(self.getOrDefault("transformers")))
        return ColumnTransformersModel(plan=json.dumps(steps), outputCol=self.getOutputCol())


class ColumnTransformersModel(Model, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    plan = Param(Params._dummy(), "plan", "steps of each feature as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, plan: str = "{}", outputCol: str = "features"):
        super().__init__()
        self._setDefault(plan="{}", outputCol="features")
        self._set(**self._input_kwargs)

    def steps(self) -> dict[str, list]:
        return json.loads(self.getOrDefault("plan"))

    def feature_order(self) -> list[str]:
        discrete, numeric = split_discrete_numeric(list(self.steps()))
        return [*discrete, *numeric]

    def prepared_columns(self) -> dict[str, Column]:
        """Name -> prepared expression, in vector order; a value that no step fills stays missing (NaN)."""
        steps = self.steps()
        return {c: F.coalesce(apply_steps(nan_to_null(q(c).cast("double")), steps[c]), F.lit(float("nan"))) for c in self.feature_order()}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.array(*self.prepared_columns().values())))
