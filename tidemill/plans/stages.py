"""A maintenance run: stages in their order, each of which plans changes to named tables and, when applied, hands the
changed tables to the next."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.writers import Mode

# The stages in their default order.
ORDER = ["dedup", "junk", "names", "parse", "foods", "units", "labels", "tools", "taxonomy", "categorize", "cookbooks", "yield", "quality", "audit"]

Tables = dict[str, DataFrame]
#: Of the tables, the plan and the tables as they would be.
Stage = Callable[[Mapping[str, DataFrame]], tuple[DataFrame, Tables]]


@dataclass
class Outcome:
    stage: str
    status: str
    seconds: float
    planned: int = 0
    error: str = ""


@dataclass
class Run:
    outcomes: list[Outcome] = field(default_factory=list)
    tables: Tables = field(default_factory=dict)
    plans: Tables = field(default_factory=dict)

    def summary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, o.stage, o.status, o.seconds, o.planned, o.error) for i, o in enumerate(self.outcomes)], "seq int, stage string, status string, seconds double, planned long, error string")


def stage_list(text: str | None, known: Sequence[str] = ORDER) -> list[str]:
    """Stages named between commas, none twice; all of them by default, an error for an unknown one."""
    names = list(dict.fromkeys(x.strip().lower() for x in (text or "").split(",") if x.strip())) or list(known)
    unknown = [x for x in names if x not in known]
    if unknown:
        raise ValueError(f"unknown stages: {', '.join(unknown)}")
    return names


def run(stages: Mapping[str, Stage], tables: Mapping[str, DataFrame], names: Sequence[str] | None = None, mode: Mode = Mode(), stop_on_error: bool = False) -> Run:
    """Run the named stages over the tables.  A stage that fails is told so and, unless told otherwise, the others go on;
    without an executable mode every stage sees the tables as they were."""
    done = Run(tables=dict(tables))
    for name in names or [s for s in ORDER if s in stages]:
        began = time.monotonic()
        try:
            plan, changed = stages[name](done.tables)
            planned = plan.count()
            done.plans[name] = plan
            if mode.executable:
                done.tables |= changed
            done.outcomes.append(Outcome(name, "ok", time.monotonic() - began, planned))
        except Exception as e:  # a stage's failure is part of the report
            done.outcomes.append(Outcome(name, "failed", time.monotonic() - began, error=str(e)[:220]))
            if stop_on_error:
                break
    return done
