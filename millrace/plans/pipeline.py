"""Declared pipelines: named stages, folded into one plan, and what a run leaves behind."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.operators import aggregate as _aggregate
from millrace.operators import clean as _clean
from millrace.operators import mapping as _mapping
from millrace.operators import normalize as _normalize
from millrace.operators import resolve as _resolve
from millrace.operators import validate as _validate
from millrace.session import settle_table
from millrace.sources.sinks import write_records, write_rejected

#: Shares of failed records beyond which a run is called off.
MOST_FAILED = 1.0


@dataclass
class Stage:
    """One step: what it does to a table and the columns it needs. An optional one is left out where these are missing."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    needs: list[str] = field(default_factory=list)
    optional: bool = False


@dataclass
class PipelineSpec:
    """Stages in order; names are unique."""

    name: str
    stages: list[Stage]
    most_failed: float = MOST_FAILED

    def problems(self) -> list[str]:
        names = [s.name for s in self.stages]
        found = [f"stage {n} is there {names.count(n)} times" for n in dict.fromkeys(names) if names.count(n) > 1]
        return found + ([] if names else ["no stages"]) + ([] if 0 <= self.most_failed <= 1 else ["most_failed is a share"])


@dataclass
class Outcome:
    """Counts of a run, and its status."""

    read: int
    accepted: int
    rejected: int
    warned: int

    @property
    def status(self) -> str:
        return "SUCCESS" if not self.rejected else "PARTIAL" if self.accepted else "FAILED"


def clean_stage(config: _clean.CleanConfig, **options) -> Stage:
    return Stage("clean", lambda df: _clean.clean(df, config), sorted(config.fields), **options)


def validate_stage(rules: list[_validate.Rule], order: str, references: dict | None = None, **options) -> Stage:
    return Stage("validate", lambda df: _validate.validate(df, rules, order, references), sorted({r.field for r in rules if r.field}), **options)


def normalize_stage(columns: dict[str, Column], rules: list[dict] | None = None, **options) -> Stage:
    """Columns from expressions, then business rules."""
    return Stage("normalize", lambda df: _normalize.business_rules(df.withColumns(columns), rules or []), **options)


def map_stage(mappings: list[_mapping.Mapping], tables: dict[str, DataFrame] | None = None, **options) -> Stage:
    return Stage("map", lambda df: _mapping.apply_mappings(df, mappings, tables), [m.source for m in mappings if m.source and m.required], **options)


def match_stage(key: str, rules: list[_resolve.MatchRule], threshold: float, strategy: str = "merge", **options) -> Stage:
    """Duplicates become one record."""

    def apply(df: DataFrame) -> DataFrame:
        links, members = _resolve.similar_records(df, key, rules, threshold)
        return _resolve.merged(df, key, _resolve.groups(links, members, key), strategy).withColumnRenamed("master", key)

    return Stage("match", apply, [key, *(r.field for r in rules)], **options)


def aggregate_stage(keys: list[_aggregate.Key], measures: list[_aggregate.Measure], **options) -> Stage:
    return Stage("aggregate", lambda df: _aggregate.aggregate(df, keys, measures), sorted({m.source for m in measures}), **options)


def folded(spec: PipelineSpec, df: DataFrame) -> DataFrame:
    """All stages as one lazy plan; rows with warnings go on."""
    if found := spec.problems():
        raise ValueError("; ".join(found))
    for stage in spec.stages:
        missing = [c for c in stage.needs if c not in df.columns]
        if missing and stage.optional:
            continue
        if missing:
            raise ValueError(f"stage {stage.name} lacks {', '.join(missing)}")
        df = stage.apply(df)
    return df


def failed() -> Column:
    return F.col("_status") == "FAILED"


def run(spec: PipelineSpec, df: DataFrame, accepted: str, rejected: str) -> Outcome:
    """Run a pipeline that validates: accepted rows to one table, failed ones to another.

    The annotated rows are written once and read for both; counts are observed on the way. If
    more than the allowed share failed, nothing is loaded.
    """
    seen = Observation()
    out = folded(spec, df)
    if "_status" not in out.columns:
        out = out.withColumns({"_status": F.lit("SUCCESS"), "_errors": F.array().cast("array<struct<field:string,rule:string,severity:string>>")})
    counted = out.observe(seen, F.count("*").alias("read"), F.count_if(failed()).alias("rejected"), F.count_if(F.col("_status") == "WARNING").alias("warned"))
    rows = settle_table(counted)
    got = seen.get
    outcome = Outcome(got["read"], got["read"] - got["rejected"], got["rejected"], got["warned"])
    if outcome.rejected <= spec.most_failed * outcome.read:
        good, bad = _validate.accepted_and_rejected(rows)
        write_records(good.drop("_errors", "_status", "_score"), accepted)
        write_rejected(bad, rejected)
    return outcome
