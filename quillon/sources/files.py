"""Scans and sinks: cohort CSV files, their headers, the dictionary of variables, tables, and small reports."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NA = ("", "NA", "N/A", "nan", "NaN", "None", "null")
#: Spark types of the dictionary's type names.
TYPES = {"float": "double", "int8 binary": "int", "int8 ordinal": "int", "int8 categorical": "int", "string": "string", "category": "string", "date (YYYY-MM-DD)": "date"}
REQUIRED = ("canonical_name", "dtype", "section")


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV file, without a byte order mark; quoted names may hold commas. One line is read."""
    first = spark.read.text(path).limit(1).collect()
    return [c.strip() for c in next(csv.reader([first[0][0].lstrip("﻿")]), [])] if first else []


def scan_csv(spark: SparkSession, path: str, columns: Iterable[str], required: Iterable[str] = (), visits: Iterable[str] | None = None, visit: str = "visit") -> DataFrame:
    """The wanted columns of a cohort's file that it has, as strings; only wanted visits. Missing required ones are refused."""
    names = header(spark, path)
    lacking = [c for c in required if c not in names]
    if lacking:
        raise ValueError(f"{path} lacks {lacking}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, nullValue="")
    df = df.where(F.col(visit).isin(*visits)) if visits is not None and visit in names else df
    wanted = set(columns) | set(required)
    return df.select(*[c for c in names if c in wanted])


@dataclass(frozen=True)
class Variable:
    """A row of the dictionary."""

    canonical_name: str
    dtype: str
    section: str
    sources: dict[str, str]
    sanity_min: float | None = None
    sanity_max: float | None = None
    readiness: str | None = None


def _number(x: str | None) -> float | None:
    try:
        return float(x) if x is not None else None
    except ValueError:
        return None


def read_dictionary(spark: SparkSession, path: str, cohorts: tuple[str, ...] = ("bp", "sz", "dr")) -> list[Variable]:
    """Variables of a CSV or XLSX dictionary (a few hundred rows); NA spellings are missing, a later row of a name wins."""
    if path.endswith(".xlsx"):
        rows = read_sheet(spark, path)
        if rows and (lacking := [c for c in REQUIRED if c not in rows[0]]):
            raise ValueError(f"{path} lacks {lacking}")
    else:
        rows = [r.asDict() for r in scan_csv(spark, path, header(spark, path), REQUIRED).collect()]
    found: dict[str, Variable] = {}
    for r in rows:
        row = {k: None if v is None or v.strip() in NA else v.strip() for k, v in r.items()}
        if row["canonical_name"]:
            sources = {c: row[f"{c}_csv_col"] for c in cohorts if row.get(f"{c}_csv_col")}
            found[row["canonical_name"]] = Variable(row["canonical_name"], row["dtype"] or "string", row["section"] or "", sources, _number(row.get("sanity_min")), _number(row.get("sanity_max")), row.get("cluster_readiness"))
    return list(found.values())


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file's bytes, from any store that Spark reads."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    return bytes(rows[0][0])


def read_sheet(spark: SparkSession, path: str, sheet: int = 0) -> list[dict[str, str | None]]:
    """The rows of a workbook's sheet as text, by the names in its first row; whole numbers without decimals."""
    book = zipfile.ZipFile(io.BytesIO(read_bytes(spark, path)))
    tag = lambda e: e.tag.rpartition("}")[2]
    text = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
    shared = [text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
    names = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    table: list[dict[int, str]] = []
    for row in (e for e in ElementTree.fromstring(book.read(names[sheet])).iter() if tag(e) == "row"):
        cells: dict[int, str] = {}
        for place, cell in enumerate(row):
            letters = re.match(r"[A-Z]*", cell.get("r", "")).group()
            at = sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters))) - 1 if letters else place
            value = next((e.text for e in cell if tag(e) == "v"), None)
            if cell.get("t") == "s":
                cells[at] = shared[int(value)]
            elif cell.get("t") == "inlineStr":
                cells[at] = text(cell)
            elif value is not None:
                cells[at] = re.sub(r"\.0+$", "", value)
        table.append(cells)
    if not table:
        return []
    return [{name: r.get(k) for k, name in table[0].items()} for r in table[1:] if r]


def in_section(variables: list[Variable], sections: Iterable[str] | None = None, types: Iterable[str] | None = None) -> list[Variable]:
    """Variables of the sections and of the types, of any where none are named."""
    sections, types = (None if s is None else set(s) for s in (sections, types))
    return [v for v in variables if (sections is None or v.section in sections) and (types is None or v.dtype in types)]


def matching_readiness(variables: list[Variable], prefixes: tuple[str, ...]) -> list[Variable]:
    return [v for v in variables if (v.readiness or "").startswith(prefixes)]


def unified(spark: SparkSession, paths: dict[str, str], variables: list[Variable], keys: tuple[str, ...] = ("patient", "visit"), visits: Iterable[str] | None = None) -> DataFrame:
    """One frame of all cohorts: typed canonical columns within their bounds, missing where a cohort has no source."""
    parts = []
    for cohort, path in paths.items():
        df = scan_csv(spark, path, [v.sources[cohort] for v in variables if cohort in v.sources], keys, visits)
        cols = []
        for v in variables:
            source = v.sources.get(cohort)
            kind = TYPES.get(v.dtype, "string")
            c = F.col(source).try_cast(kind) if source in df.columns else F.lit(None).cast(kind)
            if v.sanity_min is not None:
                c = F.when(c >= v.sanity_min, c)
            if v.sanity_max is not None:
                c = F.when(c <= v.sanity_max, c)
            cols.append(c.alias(v.canonical_name))
        parts.append(df.select(F.lit(cohort.upper()).alias("cohort"), *keys, *cols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small aggregate as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON or YAML configuration from any store that Spark reads."""
    text = read_bytes(spark, path).decode("utf-8-sig")
    return parse_yaml(text) if path.endswith((".yaml", ".yml")) else json.loads(text)


def _scalar(text: str) -> object:
    """A plain, quoted or bracketed value of a configuration line."""
    text = text.strip()
    if text[:1] in "\"'" and len(text) > 1 and text[-1] == text[0]:
        return text[1:-1]
    text = re.sub(r"\s+#.*$", "", text).strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(p) for p in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\s][^,]*", text[1:-1])]
    if text.lower() in ("", "~", "null"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def parse_yaml(text: str) -> dict | list | None:
    """Nested mappings, lists and plain values of a configuration; anchors, tags and block texts are refused."""
    lines = []
    for raw in text.split("\n"):
        line = re.sub(r"^\s*#.*$", "", raw).rstrip()
        if line.strip() in ("", "---"):
            continue
        if "\t" in line[: len(line) - len(line.lstrip())] or re.search(r"(^|[:\-]\s)\s*[&*!|>]", line):
            raise ValueError(f"not supported: {raw!r}")
        lines.append((len(line) - len(line.lstrip()), line.strip()))

    def block(at: int, indent: int) -> tuple[object, int]:
        out: dict | list | None = None
        while at < len(lines) and lines[at][0] == indent:
            line = lines[at][1]
            if line == "-" or line.startswith("- "):
                out = [] if out is None else out
                rest = line[1:].strip()
                if rest and re.match(r"[^\"'\[{][^:]*:(\s|$)", rest):  # a mapping that begins on the mark's line
                    lines[at] = (indent + len(line) - len(rest), rest)
                    value, at = block(at, lines[at][0])
                elif rest:
                    value, at = _scalar(rest), at + 1
                else:
                    value, at = block(at + 1, lines[at + 1][0]) if at + 1 < len(lines) and lines[at + 1][0] > indent else (None, at + 1)
                out.append(value)
                continue
            out = {} if out is None else out
            name, _, rest = line.partition(":")
            at += 1
            if rest.strip() and not rest.strip().startswith("#"):
                value = _scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("-")):
                value, at = block(at, lines[at][0])
            else:
                value = None
            out[str(_scalar(name))] = value
        return out, at

    return block(0, lines[0][0])[0] if lines else None


def read_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The arrays of an NPZ file: parameters, whose size doesn't depend on the number of rows."""
    with np.load(io.BytesIO(read_bytes(spark, path)), allow_pickle=False) as found:
        return {k: found[k] for k in found.files}


def write_arrays(spark: SparkSession, path: str, arrays: dict[str, np.ndarray]) -> None:
    """An NPZ file of named arrays, in any store that Spark writes."""
    raw = io.BytesIO()
    np.savez_compressed(raw, **arrays)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(raw.getvalue()))
    out.close()


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    """name, chain, draw, place, value of posterior draws kept as NPZ arrays [chain, draw, ...]."""
    rows = [(n, c, d, k, float(v)) for n, a in read_arrays(spark, path).items() for c in range(a.shape[0]) for d in range(a.shape[1]) for k, v in enumerate(np.ravel(a[c, d]))]
    return spark.createDataFrame(rows, "name string, chain int, draw int, place int, value double")


def generate_cohort(spark: SparkSession, n: int, loadings: list[list[float]], seed: int = 0, missing: float = 0.25, cohorts: tuple[tuple[str, float], ...] = (("bp", 0.62), ("sz", 0.24), ("dr", 0.14))) -> DataFrame:
    """patient, cohort, latent f0.. and items i0..: a planted factor model with cells missing at random."""
    k = len(loadings[0])
    df = spark.range(n).withColumnRenamed("id", "patient").withColumn("_u", F.rand(seed)).withColumns({f"f{j}": F.randn(seed + 1 + j) for j in range(k)})
    edge, cohort = 0.0, F.lit(cohorts[-1][0])
    for name, share in cohorts[:-1]:
        edge += share
        cohort = F.when((F.col("_u") < edge) & (F.col("_u") >= edge - share), name).otherwise(cohort)
    items = {}
    for i, row in enumerate(loadings):
        value = sum((F.col(f"f{j}") * w for j, w in enumerate(row)), F.randn(seed + 100 + i) * max(0.05, 1 - sum(w * w for w in row)) ** 0.5)
        items[f"i{i}"] = F.when(F.rand(seed + 1000 + i) >= missing, value)
    return df.withColumn("cohort", cohort).withColumns(items).drop("_u")
