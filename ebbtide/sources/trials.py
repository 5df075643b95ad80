"""Randomised trials as sources: which columns are read, and when a file is refused."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shaping import representative


class TrialError(ValueError):
    """A frame is not the trial it is said to be."""


@dataclass(frozen=True)
class TrialSpec:
    """What a trial's columns are.

    `after_assignment` names columns that arise once arms are assigned, such as whether a message
    was seen: they would turn a randomised comparison into an observational one, so they may be
    neither treatment, outcome nor feature. `published` has the rates of the whole file.
    """

    treatment: str
    outcomes: Sequence[str]
    features: Sequence[str]
    after_assignment: frozenset[str] = frozenset()
    published: Mapping[str, float] = field(default_factory=dict)
    key: str | None = None


def load_trial(source: DataFrame, spec: TrialSpec, outcome: str, tolerance: float = 0.20
               ) -> DataFrame:
    """Key, t, y and the features of one trial; only these columns are read.

    The rates of the frame must lie within `tolerance` of the published ones: a file that is
    ordered by arm and was read in part fails this, and is refused.
    """
    if outcome not in spec.outcomes:
        raise TrialError(f"{outcome!r} is no outcome of this trial, which has {list(spec.outcomes)}")
    used = [*([spec.key] if spec.key else []), spec.treatment, outcome, *spec.features]
    leaked = sorted(spec.after_assignment & set(used))
    if leaked:
        raise TrialError(f"{leaked} arise after assignment")
    absent = sorted({*used, *spec.published} - set(source.columns))
    if absent:
        raise TrialError(f"columns {absent} are absent")
    if spec.published:
        off = representative(source, spec.published, tolerance, spec.treatment).filter(
            ~F.coalesce("passed", F.lit(False))).collect()  # one row per published rate
        if off:
            raise TrialError("not a fair part of the trial: " + "; ".join(
                f"{r['rate']} is {r['observed']} and should be {r['published']}" for r in off))
    return source.select(*([spec.key] if spec.key else []),
                         F.col(spec.treatment).cast("int").alias("t"),
                         F.col(outcome).cast("double").alias("y"), *spec.features)
