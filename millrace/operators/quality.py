"""Data quality: any number of rules over a table in one scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expressions import parse
from millrace.functions.formats import FORMATS

PASS_RATE, GATE = 90.0, 80.0


@dataclass
class QualityRule:
    """One rule; `threshold` is the share of violations above which it fails."""

    rule_id: str
    kind: str
    column: str = ""
    params: dict[str, Any] = field(default_factory=dict)
    severity: str = "error"
    threshold: float = 0.0


def violation(rule: QualityRule) -> Column:
    """Whether a row violates the rule; what can't be judged passes."""
    p = rule.params
    c = F.col(rule.column) if rule.column else None
    match rule.kind:
        case "completeness":
            bad = c.isNull() | (F.trim(c.cast("string")) == "")
        case "uniqueness":
            bad = F.col(f"_times_{rule.rule_id}") > 1
            if p.get("scope") == "global":  # known from an earlier load
                bad = F.coalesce(bad, F.lit(False)) | F.coalesce(F.col(f"_seen_{rule.rule_id}"), F.lit(False))
        case "validity":
            ok = FORMATS[p["format"]](c) if "format" in p else c.cast("string").rlike(p["pattern"])
            bad = c.isNotNull() & (c.cast("string") != "") & ~ok
        case "consistency":
            bad = (c == F.lit(p["equals"])) & ~F.col(p["then_column"]).eqNullSafe(F.lit(p["then_equals"]))
        case "accuracy":
            bad = F.abs(c - parse(p["expression"])) > p.get("tolerance", 0)
        case "custom":
            bad = ~parse(p["expression"])
        case "range":
            bad = ~c.between(p.get("min", float("-inf")), p.get("max", float("inf")))
        case "timeliness":
            bad = c < F.expr(p["not_before"])
        case "referential" | "integrity":
            bad = c.isNotNull() & F.col(f"_known_{rule.rule_id}").isNull()
        case other:
            raise ValueError(f"no quality rule {other}")
    return F.coalesce(bad, F.lit(False))


def prepared(df: DataFrame, rules: list[QualityRule], references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """df with what uniqueness and referential rules need: counts by pre-aggregation and a left join, never by a window over a hot value.

    A uniqueness rule of scope `global` names the store.History of all loads in params["history"]; a value is then also held against that.
    """
    for r in rules:
        if r.kind == "uniqueness":
            times = df.groupBy(F.col(r.column).alias("_value")).agg(F.count("*").alias(f"_times_{r.rule_id}")).where(F.col("_value").isNotNull() & (F.col(f"_times_{r.rule_id}") > 1))
            df = df.join(times, F.col(r.column) == F.col("_value"), "left").drop("_value")
            if r.params.get("scope") == "global":
                df = r.params["history"].marked(df, [r.column], f"_seen_{r.rule_id}")
        if r.kind in ("referential", "integrity"):
            known, key = references[r.rule_id]
            df = df.join(known.select(F.col(key).alias(f"_known_{r.rule_id}")).distinct(), F.col(r.column) == F.col(f"_known_{r.rule_id}"), "left")
    return df


def scorecard(df: DataFrame, rules: list[QualityRule], references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """One row for each rule: checked, passed, failed, pass_rate and result. All rules share one aggregation."""
    ready = prepared(df, rules, references)
    one = ready.agg(F.count("*").alias("checked"), *(F.count_if(violation(r)).alias(f"_v{k}") for k, r in enumerate(rules)))
    rows = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.kind.upper()).alias("rule_type"), F.lit(r.severity).alias("severity"), F.lit(float(r.threshold)).alias("threshold"), F.col(f"_v{k}").alias("failed")) for k, r in enumerate(rules)))
    flat = one.select("checked", F.explode(rows).alias("r")).select("r.rule_id", "r.rule_type", "r.severity", "r.threshold", "checked", (F.col("checked") - F.col("r.failed")).alias("passed"), "r.failed")
    rate = F.coalesce(F.try_divide(F.col("passed") * 100.0, F.col("checked")), F.lit(100.0))
    over = F.coalesce(F.try_divide(F.col("failed").cast("double"), F.col("checked").cast("double")) > F.col("threshold"), F.lit(False))
    return flat.withColumn("pass_rate", F.round(rate, 6)).withColumn("result", F.when(over, "FAIL").otherwise("PASS")).drop("threshold")


def overall(card: DataFrame) -> DataFrame:
    """The score over all checks of a scorecard, and how many rules of each severity failed."""
    rate = F.coalesce(F.try_divide(F.sum("passed") * 100.0, F.sum("checked")), F.lit(100.0))
    return card.agg(F.sum("checked").alias("checked"), F.sum("passed").alias("passed"), F.sum("failed").alias("failed"), F.round(rate, 6).alias("score"), F.when(rate >= PASS_RATE, "PASS").otherwise("FAIL").alias("status"), F.count_if((F.col("result") == "FAIL") & (F.col("severity") == "critical")).alias("critical_failures"), F.count_if((F.col("result") == "FAIL") & (F.col("severity") == "warning")).alias("warning_failures"))


def violations(df: DataFrame, rules: list[QualityRule], key: str, references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """A row for each violation: the record's key, the rule and the value."""
    ready = prepared(df, rules, references)
    found = F.array_compact(F.array(*(F.when(violation(r), F.struct(F.lit(r.rule_id).alias("rule_id"), (F.col(r.column).cast("string") if r.column else F.lit(None).cast("string")).alias("value"))) for r in rules)))
    return ready.select(F.col(key).alias("record_id"), F.explode(found).alias("v")).select("record_id", "v.rule_id", "v.value")


def record_scores(df: DataFrame, rules: list[QualityRule], key: str) -> DataFrame:
    """Errors and share of passed rules of each record."""
    bad = reduce(lambda a, b: a + b, (violation(r).cast("int") for r in rules))
    return df.select(F.col(key).alias("record_id"), bad.alias("errors"), (1 - bad / len(rules)).alias("validation_score"))


def gate(card: DataFrame, least: float = GATE) -> DataFrame:
    """Rules whose pass rate calls for an alert."""
    return card.where(F.col("pass_rate") < least)


def trend(checks: DataFrame, at: str, period: str) -> DataFrame:
    """Checked, passed and pass rate by period."""
    return checks.groupBy(F.date_trunc(period, at).alias("period")).agg(F.sum("checked").alias("checked"), F.sum("passed").alias("passed")).withColumn("pass_rate", F.round(F.try_divide(F.col("passed") * 100.0, F.col("checked")), 6))


def weighted_score(checks: DataFrame, result: str = "result") -> DataFrame:
    """Passes count one and warnings a half."""
    return checks.agg(F.round(F.avg(F.when(F.col(result) == "PASS", 1.0).when(F.col(result) == "WARNING", 0.5).otherwise(0.0)), 6).alias("quality_score"))


def latest(checks: DataFrame, key: str, order: str) -> DataFrame:
    """The last check of each key; ranking is cut off before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return checks.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def report(checks: DataFrame, rules: DataFrame, since: str, until: str) -> DataFrame:
    """Checks, failures and pass rate by rule_type of the checks in [since, until); checks without a rule are left out."""
    rows = checks.where((F.col("checked_at") >= F.lit(since)) & (F.col("checked_at") < F.lit(until))).join(rules, "rule_id")
    return rows.groupBy("rule_type").agg(F.count("*").alias("checks"), F.sum("failed").alias("failed"), F.round(F.try_divide(F.sum("passed") * 100.0, F.sum("checked")), 6).alias("pass_rate"))


def alerts(checks: DataFrame, rules: DataFrame, severities: list[str] | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of failed checks with their rule, those with most failures first."""
    rows = checks.where("result = 'FAIL'").join(rules.where(F.col("severity").isin(*severities)) if severities else rules, "rule_id")
    page = rows.orderBy(F.desc("failed"), "check_id").offset(offset).limit(limit)
    return page.select("check_id", "rule_id", "rule_type", "severity", F.round(F.try_divide(F.col("failed").cast("double"), F.col("checked").cast("double")), 6).alias("failure_rate"))


def rule_usage(checks: DataFrame, now: Any, days: int = 30) -> DataFrame:
    """How often each rule was used in the last days, and how checks and records came out."""
    rows = checks.where(F.col("checked_at") >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS")).groupBy("rule_id")
    passed = F.count_if(F.col("result") == "PASS")
    return rows.agg(
        F.count("*").alias("checks"),
        passed.alias("passed_checks"),
        (F.count("*") - passed).alias("failed_checks"),
        F.round(passed * 100.0 / F.count("*"), 6).alias("pass_rate"),
        F.sum("checked").alias("records_checked"),
        F.sum("passed").alias("records_passed"),
        F.round(F.try_divide(F.sum("passed") * 100.0, F.sum("checked")), 6).alias("record_pass_rate"),
        F.max("checked_at").alias("last_used"),
    )


def entity_scorecard(entities: DataFrame, type_column: str, kind: str, data: str, fields: str, rules: list[QualityRule], ids: tuple[str, list] | None = None) -> DataFrame:
    """A scorecard over the entities (or records of a file) of one kind: their own columns and the fields of their JSON.

    ids: a column and the values that are looked at. A field of the JSON takes the place of a column of its name.
    """
    rows = entities.where(F.col(type_column) == kind)
    if ids:
        rows = rows.where(F.col(ids[0]).isin(*ids[1]))
    read = rows.withColumn("_data", F.from_json(data, fields))
    inner = read.select("_data.*").columns
    return scorecard(read.select(*(c for c in rows.columns if c != data and c not in inner), "_data.*"), rules)
