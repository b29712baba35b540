"""Files as DataFrames: CSV, JSON, XML, archives and what tells how to read them.

Whatever looks at a file first looks at a few of its lines, read by Spark, so that inputs may
be in any store that Spark reads.
"""

from __future__ import annotations

import csv
import io
import re
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

DELIMITERS = (",", ";", "\t", "|", ":")
SNIFFED_LINES, CHECKED_LINES, XML_LINES = 5, 10, 2000
LARGEST_CSV = 1 << 30
MOST_SPREAD = 5
# Names under which services put their records.
RECORD_KEYS = ("data", "results", "items", "records", "response", "content")
NAMES = {
    "csv": ("csv", "text/csv", "application/csv", "tsv"),
    "excel": ("excel", "xlsx", "xls", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel"),
    "json": ("json", "jsonl", "application/json", "text/json", "application/x-ndjson"),
    "xml": ("xml", "application/xml", "text/xml"),
    "api": ("api", "rest", "http"),
    "parquet": ("parquet", "application/x-parquet"),
    "text": ("text", "txt", "text/plain"),
    "avro": ("avro",),
    "orc": ("orc",),
}


def source_kind(name: str) -> str:
    """The kind of source that a name, extension or media type tells; a part of it is enough."""
    low = name.strip().lower().lstrip(".")
    for kind, names in NAMES.items():
        if low in names:
            return kind
    for kind, names in NAMES.items():
        if any(n in low for n in names):
            return kind
    raise ValueError(f"no source for {name}")


def head(spark: SparkSession, path: str, lines: int) -> list[bytes]:
    """The first lines of a file, undecoded."""
    rows = spark.read.text(path).select(F.col("value").cast("binary").alias("v")).limit(lines).collect()
    return [bytes(r.v) for r in rows]


def detect_encoding(sample: list[bytes]) -> str:
    """By byte order mark, else UTF-8 if the sample decodes as such, else Latin-1."""
    raw = b"\n".join(sample)
    if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "UTF-16"
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return "ISO-8859-1"
    return "UTF-8"


def detect_delimiter(lines: list[str]) -> str:
    """What a sniffer finds, else the most frequent candidate, else a comma."""
    sample = "\n".join(lines[:SNIFFED_LINES])
    try:
        return csv.Sniffer().sniff(sample, "".join(DELIMITERS)).delimiter
    except csv.Error:
        counts = Counter({d: sample.count(d) for d in DELIMITERS if d in sample})
        return counts.most_common(1)[0][0] if counts else ","


def csv_kinds(spark: SparkSession, path: str) -> DataFrame:
    """For each file with lines: its encoding, by all of its bytes, and whether a line has an odd number of quotes, as where a quoted value goes on in the next."""
    line = F.col("value").cast("binary")
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    marked = F.max(F.substring(line, 1, 2).isin(F.lit(b"\xff\xfe"), F.lit(b"\xfe\xff"))) & F.max(F.contains(line, F.lit(b"\0")))
    encoding = F.when(marked, "UTF-16").when(F.min(F.expr("is_valid_utf8(value)")), "UTF-8").otherwise("ISO-8859-1")
    return spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(encoding.alias("encoding"), F.max(quotes % 2 == 1).alias("odd"))


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """All columns as text; names and values trimmed, empty ones null.

    Encoding and whether values hold line breaks are told for each file from all of it, in one
    distributed pass, unless both are given. Only files without such values are split among tasks;
    line breaks in values become line feeds.
    """
    if delimiter is None:
        sample = head(spark, path, CHECKED_LINES)
        delimiter = detect_delimiter(b"\n".join(sample).decode(encoding or detect_encoding(sample), "replace").splitlines())
    kinds: dict[tuple[str, bool], list[str]] = {}
    for r in csv_kinds(spark, path).collect() if encoding is None or multi_line is None else []:
        told = encoding or r.encoding
        wide = told.upper().startswith(("UTF-16", "UTF-32"))
        kinds.setdefault((told, (r.odd or wide) if multi_line is None else multi_line), []).append(r.file)
    if len(kinds) < 2:
        told, broken = next(iter(kinds), (encoding or "UTF-8", bool(multi_line)))
        rows = _csv(spark, path, delimiter, told, broken)
    else:
        base = {"basePath": path} if all(f"{path.rstrip('/')}/" in unquote(f) for x in kinds.values() for f in x) else {}
        rows = None
        for (told, broken), found in sorted(kinds.items()):
            paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(f)) for f in found]
            more = _csv(spark, paths, delimiter, told, broken, rows and rows.schema, **base)
            rows = rows.union(more) if rows else more
    return rows.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in rows.columns))


def _csv(spark: SparkSession, path: str | list[str], delimiter: str, encoding: str, multi_line: bool, schema: StructType | None = None, **options: str) -> DataFrame:
    return spark.read.options(encoding=encoding, **options).csv(path, schema, sep=delimiter, header=True, inferSchema=False, escape='"', multiLine=multi_line)


def check_csv(spark: SparkSession, path: str, size: int, delimiter: str = ",") -> DataFrame:
    """One row: whether extension, size and the spread of column counts in the first lines are right."""
    lines = spark.read.text(path).limit(CHECKED_LINES).select((F.size(F.split("value", f"\\Q{delimiter}\\E"))).alias("n"))
    named = path.rstrip("/").lower().endswith((".csv", ".tsv", ".txt"))
    spread = F.coalesce(F.max("n") - F.min("n"), F.lit(0))
    return lines.agg(F.lit(named).alias("named"), F.lit(0 < size <= LARGEST_CSV).alias("sized"), F.count("*").alias("lines"), (spread <= MOST_SPREAD).alias("even"))


def json_structure(lines: list[str]) -> str:
    """array, jsonl, object or invalid, by the first two lines."""
    first = lines[0].lstrip("﻿ \t") if lines else ""
    if first.startswith("["):
        return "array"
    if first.startswith("{"):
        return "jsonl" if len(lines) > 1 and lines[1].strip().startswith("{") else "object"
    return "invalid"


def _at(c: Column, kind, path: str) -> tuple[Column, object]:
    for name in path.split("."):
        if isinstance(kind, ArrayType) and name.isdigit():
            c, kind = F.get(c, F.lit(int(name))), kind.elementType
        elif isinstance(kind, StructType) and name in kind.names:
            c, kind = c[name], kind[name].dataType
        else:
            return F.lit(None), None
    return c, kind


def read_json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records of JSON lines, and the lines that don't parse: file, line and reason. Blank lines are neither."""
    schema = spark.read.json(path, mode="DROPMALFORMED").schema
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    wanted = StructType([*schema.fields, StructField("_corrupt", StringType())])
    parsed = lines.withColumn("r", F.from_json("value", wanted, {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    good = parsed.where(~bad).select("r.*").drop("_corrupt")
    return good, parsed.where(bad).select("file", F.col("value").alias("line"), F.lit("not a JSON record").alias("rejection_reason"))


def read_json(spark: SparkSession, path: str, structure: str | None = None, json_path: str | None = None) -> DataFrame:
    """Records of a JSON file.

    Lines that don't parse are left out here; read_json_lines() gives them, too. Of a single object come the elements at json_path, or
    of its first array of records; of an array of plain values come `value` and `_index`; an
    object without arrays is one record.
    """
    if structure is None:
        structure = "object" if json_path else json_structure([x.decode("utf-8", "replace") for x in head(spark, path, 2)])
    if structure == "invalid":
        raise ValueError(f"no JSON in {path}")
    if structure == "jsonl":
        return read_json_lines(spark, path)[0]
    rows = spark.read.json(path, multiLine=True)
    if structure == "array":
        return rows
    if json_path:
        c, kind = _at(F.struct("*"), rows.schema, json_path)
    else:
        found = [f for f in rows.schema.fields if isinstance(f.dataType, ArrayType)]
        found.sort(key=lambda f: not isinstance(f.dataType.elementType, StructType))
        if not found:
            return rows
        c, kind = F.col(found[0].name), found[0].dataType
    if kind is None:
        return spark.createDataFrame([], "value string")
    if not isinstance(kind, ArrayType):
        return rows.select(c.alias("r")).select("r.*") if isinstance(kind, StructType) else rows.select(c.alias("value"))
    if isinstance(kind.elementType, StructType):
        return rows.select(F.inline(c))
    return rows.select(F.posexplode(c).alias("_index", "value"))


def records_in(c: Column, schema: str) -> Column:
    """The array of records in a JSON response: the response itself, one of the usual fields, or the response as the only one."""
    usual = [F.from_json(F.get_json_object(c, f"$.{k}"), f"array<{schema}>") for k in RECORD_KEYS]
    whole = F.when(F.ltrim(c).startswith("["), F.from_json(c, f"array<{schema}>"))
    return F.coalesce(whole, *usual, F.array(F.from_json(c, schema)))


def row_tag(lines: list[str]) -> str:
    """The element that holds a record: the most frequent one among those that repeat nearest to the root, else the root."""
    parser = ET.XMLPullParser(["start", "end"])
    parser.feed("\n".join(lines))
    depth, counts = 0, Counter()
    try:
        for event, element in parser.read_events():
            if event == "start":
                counts[depth, element.tag.rpartition("}")[2]] += 1
            depth += 1 if event == "start" else -1
    except ET.ParseError as e:
        raise ValueError("no XML") from e
    if not counts:
        raise ValueError("no XML")
    for level in range(1, max(d for d, _ in counts) + 1):
        here = {tag: n for (d, tag), n in counts.items() if d == level and n > 1}
        if here:
            return max(here, key=here.get)
    return next(tag for d, tag in counts if d == 0)


def read_xml(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """A row for each element of that name: attributes as `@name`, text beside them as `_text`, repeated elements as arrays, without namespaces."""
    tag = tag or row_tag([x.decode("utf-8", "replace") for x in head(spark, path, XML_LINES)])
    return spark.read.format("xml").options(rowTag=tag, attributePrefix="@", valueTag="_text", ignoreNamespace="true", inferSchema="true").load(path)


def read_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A query over named tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query on a database; with partitionColumn, bounds and numPartitions among the options it is read in parallel."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def valid_rows(raw: DataFrame, most: int = 10_000) -> DataFrame:
    """What a run without a query of its own takes: a limited number of valid records, the first by row number."""
    return raw.where("validation_status = 'VALID'").orderBy("row_number").limit(most)


@dataclass
class Preview:
    rows: DataFrame
    total: int
    columns: list[str]


def preview(df: DataFrame, most: int = 10) -> Preview:
    """A few rows, how many there are, and the columns."""
    return Preview(df.limit(most), df.count(), df.columns)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            data = io.BytesIO(content)
            if zipfile.is_zipfile(data):
                with zipfile.ZipFile(data) as z:
                    for i in z.infolist():
                        if not i.is_dir():
                            yield pd.DataFrame({"archive": [path], "member": [i.filename], "size": [i.file_size], "content": [z.read(i)]})
            else:
                data.seek(0)
                with tarfile.open(fileobj=data, mode="r|*") as t:
                    for i in t:
                        if i.isfile():
                            yield pd.DataFrame({"archive": [path], "member": [i.name], "size": [i.size], "content": [t.extractfile(i).read()]})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file in zip and tar archives; a task holds an archive and one of its members."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_members, "archive string, member string, size long, content binary")


def _excel(spark: SparkSession, path: str, **options) -> DataFrame:
    from millrace.sources.excel import read_excel

    return read_excel(spark, path, **options)


def _rest(spark: SparkSession, path: str, **options) -> DataFrame:
    from millrace.sources.rest import read_rest

    return read_rest(spark, path, **options)


READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": read_csv,
    "json": read_json,
    "xml": read_xml,
    "excel": _excel,
    "api": _rest,
    "parquet": lambda spark, path: spark.read.parquet(path),
    "orc": lambda spark, path: spark.read.orc(path),
    "text": lambda spark, path: spark.read.text(path),
    "avro": lambda spark, path: spark.read.format("avro").load(path),
}


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """A source by the name of its kind."""
    return READERS[source_kind(kind)](spark, path, **options)
