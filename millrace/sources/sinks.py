"""Where results go."""

from __future__ import annotations

import html
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REJECTED_COLUMNS = ("source_record_id", "row_number", "rejection_reason", "can_retry", "is_resolved", "rejected_at")
REPORT_ROWS = 1000


def write_records(df: DataFrame, path: str, partition_by: Iterable[str] = (), mode: str = "append") -> None:
    """Parquet, partitioned by what later reads will ask for; rows are dealt out by those columns and split where one value has many."""
    keys = list(partition_by)
    rows = df.hint("rebalance", *keys) if keys else df
    writer = rows.write.mode(mode)
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def backup(df: DataFrame, path: str, kind: str = "json", name: str = "records") -> None:
    """Compressed JSON lines, CSV or SQL; nested columns go into CSV and SQL as JSON."""
    if kind == "json":
        df.write.mode("overwrite").option("compression", "gzip").json(path)
    elif kind == "csv":
        flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
        flat.write.mode("overwrite").option("compression", "gzip").csv(path, header=True)
    elif kind == "sql":
        insert_statements(df, name).write.mode("overwrite").option("compression", "gzip").text(path)
    else:
        raise ValueError(f"no backup as {kind}")


def insert_statements(df: DataFrame, name: str) -> DataFrame:
    """`value`: a statement for each row that puts it back into a table of that name; nested columns go in as JSON."""

    def literal(c: str, kind: str) -> Column:
        plain = F.to_json(c) if kind.startswith(("array", "struct", "map")) else F.col(c).cast("string")
        quoted = kind.startswith(("array", "struct", "map", "string", "date", "timestamp", "binary"))
        return F.coalesce(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("''")), F.lit("'")) if quoted else plain, F.lit("NULL"))

    head = f"INSERT INTO {name} ({', '.join(df.columns)}) VALUES ("
    return df.select(F.concat(F.lit(head), F.concat_ws(", ", *(literal(c, t) for c, t in df.dtypes)), F.lit(");")).alias("value"))


def export(df: DataFrame, folder: str, name: str, kind: str = "json") -> str:
    """A report, executions or lineage under a name of its own, as JSON or CSV; the path is returned."""
    path = f"{folder.rstrip('/')}/{name}.{kind}"
    backup(df, path, kind, name)
    return path


def write_rejected(df: DataFrame, path: str) -> None:
    """The six columns that say what was rejected and why, as CSV; those that df lacks stay empty."""
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in REJECTED_COLUMNS)).write.mode("overwrite").csv(path, header=True)


def archive(df: DataFrame, path: str) -> None:
    """Rows that retention takes out, as compressed JSON lines beside earlier ones."""
    df.write.mode("append").option("compression", "gzip").json(path)


def aggregated_rows(df: DataFrame, name: str, keys: list[str], measures: list[str], period: str | None = None) -> DataFrame:
    """An aggregate in the common form: its name, keys and measures as JSON, and the period."""
    shown = F.col(period).cast("string") if period else F.lit(None).cast("string")
    return df.select(F.lit(name).alias("aggregation_name"), F.to_json(F.struct(*keys)).alias("dimension_keys"), F.to_json(F.struct(*measures)).alias("measure_values"), shown.alias("time_period"))


def report_html(df: DataFrame, title: str, most: int = REPORT_ROWS) -> str:
    """A small table as a page; a report shows at most so many rows."""
    rows = df.limit(most).collect()
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values) + "</tr>"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table>{cells('th', df.columns)}{''.join(cells('td', r) for r in rows)}</table></body></html>"
