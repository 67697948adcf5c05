"""Credit tables from CSV with declared types, validated, and audited: ``python -m riskloom.sources.tables DIR``."""

from __future__ import annotations

import argparse
import io
import os
import zipfile
from collections.abc import Iterator
from csv import reader
from pathlib import Path
from typing import IO

import pyarrow as pa
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.numeric import clean
from riskloom.operators.filters import rows_of

# File, key and required columns of each table.
TABLES = {
    "application_train": ("application_train.csv", "SK_ID_CURR", ["SK_ID_CURR", "TARGET"]),
    "application_test": ("application_test.csv", "SK_ID_CURR", ["SK_ID_CURR"]),
    "bureau": ("bureau.csv", "SK_ID_BUREAU", ["SK_ID_CURR", "SK_ID_BUREAU"]),
    "bureau_balance": ("bureau_balance.csv", None, ["SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS"]),
    "previous_application": ("previous_application.csv", "SK_ID_PREV", ["SK_ID_CURR", "SK_ID_PREV"]),
    "POS_CASH_balance": ("POS_CASH_balance.csv", None, ["SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE"]),
    "credit_card_balance": ("credit_card_balance.csv", None, ["SK_ID_CURR", "SK_ID_PREV", "MONTHS_BALANCE"]),
    "installments_payments": ("installments_payments.csv", None, ["SK_ID_CURR", "SK_ID_PREV"]),
}
DEFAULT = ["application_train", "application_test"]
ALIASES = {"train": "application_train", "test": "application_test", "pos_cash": "POS_CASH_balance", "credit_card": "credit_card_balance", "installments": "installments_payments", "previous": "previous_application"}
STRINGS = ("NAME_", "CODE_", "STATUS", "CREDIT_ACTIVE", "CREDIT_CURRENCY", "CREDIT_TYPE", "ORGANIZATION_TYPE", "OCCUPATION_TYPE", "WEEKDAY_", "PRODUCT_", "CHANNEL_", "FLAG_OWN_", "FLAG_LAST_APPL", "FONDKAPREMONT", "HOUSETYPE", "WALLSMATERIAL", "EMERGENCYSTATE")
WHOLE = ("SK_ID_", "MONTHS_BALANCE", "TARGET", "NUM_INSTALMENT_NUMBER")
FOLDER_VARIABLE = "RISKLOOM_DATA"
#: Bytes of unpacked text that an archive is read by.
BLOCK = 4 << 20


class SchemaError(ValueError):
    """A table does not have the shape it must have."""


def find_folder(folder: str | None = None) -> str:
    """The given folder, that of the environment variable, or data/ in or above the working directory."""
    tried = [folder, os.environ.get(FOLDER_VARIABLE), *(str(p / "data") for p in [Path.cwd(), *Path.cwd().parents])]
    for place in filter(None, tried):
        if "://" in place or any((Path(place) / f).exists() for f, _, _ in TABLES.values()) or (place == folder and detect_folder(place)):
            return place
    raise FileNotFoundError(f"no table files; looked in {[p for p in tried if p]}")


def detect_folder(root: str) -> dict[str, str]:
    """Table files anywhere below ``root``, whatever their case; a name found twice raises."""
    found: dict[str, list[str]] = {}
    for path in Path(root).rglob("*"):
        for name, (file, _, _) in TABLES.items():
            if path.is_file() and path.name.lower() == file.lower():
                found.setdefault(name, []).append(str(path))
    twice = {k: v for k, v in found.items() if len(v) > 1}
    if twice:
        raise SchemaError(f"more than one file: {twice}")
    return {k: v[0] for k, v in found.items()}


def table_names(tables: str | list[str] | None = None) -> list[str]:
    """None: the application tables; "all"; a name, an alias, or several. Unknown or no names raise."""
    asked = DEFAULT if tables is None else list(TABLES) if tables == "all" else [tables] if isinstance(tables, str) else list(tables)
    names = list(dict.fromkeys(ALIASES.get(t, t) for t in asked))
    unknown = [n for n in names if n not in TABLES]
    if unknown or not names:
        raise ValueError(f"unknown tables {unknown}; known: {sorted(TABLES)}" if unknown else "no tables")
    return names


def declared_schema(columns: list[str]) -> T.StructType:
    """Types from names: ids and months whole, names and codes text, everything else double precision."""
    kind = lambda c: T.LongType() if c.startswith("SK_ID_") else T.IntegerType() if c.startswith(WHOLE) else T.StringType() if c.startswith(STRINGS) else T.DoubleType()
    return T.StructType([T.StructField(c, kind(c)) for c in columns])


def _first_line(spark: SparkSession, path: str) -> str | None:
    row = spark.read.text(path).first()
    return None if row is None else row[0]


def _member(content: bytes, path: str) -> IO[bytes]:
    """The one CSV file of an archive, as a stream."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    inner = [n for n in archive.namelist() if n.lower().endswith(".csv")]
    if len(inner) != 1:
        raise SchemaError(f"{path}: one CSV file expected, found {inner}")
    return archive.open(inner[0])


def _zipped(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """An archive's rows as text columns, or without ``columns`` its first line alone. Unpacked in a task as it is read:
    the task holds the packed bytes and one block of rows; nothing is written to a local folder."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with _member(content.as_buffer().to_pybytes(), name) as stream:
                    yield pa.RecordBatch.from_pydict({"value": [stream.readline().decode("utf-8-sig").rstrip("\r\n")]})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {c: pa.string() for c in columns or ()}
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with _member(content.as_buffer().to_pybytes(), name) as stream:
                    yield from csv.open_csv(stream, read_options=csv.ReadOptions(block_size=BLOCK), parse_options=csv.ParseOptions(newlines_in_values=True), convert_options=csv.ConvertOptions(column_types=kinds, null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=False))

    packed = spark.read.format("binaryFile").load(path).select("path", "content")
    if columns is None:
        return packed.mapInArrow(lines, "value string")
    return packed.mapInArrow(rows, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def read_csv(spark: SparkSession, path: str, rows: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header, or a ZIP archive of one under a .csv name, with declared types and NaN as NULL.

    Any place that Spark reads will do. ``columns``: only these are read and returned.
    """
    first = _first_line(spark, path)
    packed = first is not None and first.startswith("PK\x03\x04")
    line = _zipped(spark, path).first()[0] if packed else first
    if not line:
        raise SchemaError(f"{path} is empty")
    names = next(reader([line.removeprefix("\ufeff")]))
    missing = [c for c in columns or () if c not in names]
    if missing:
        raise SchemaError(f"{path}: missing columns {missing}")
    schema = declared_schema(names)
    if packed:
        text = _zipped(spark, path, names)
        df = text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])
    else:
        df = spark.read.schema(schema).option("header", True).option("nanValue", "NaN").csv(path)
    df = clean(df.select(*columns) if columns else df)
    return df.limit(rows) if rows is not None else df


def validate(df: DataFrame, table: str) -> DataFrame:
    """``df`` if it has the table's columns, a unique key, and a target of 0 and 1 (or missing): one aggregate."""
    _, key, required = TABLES[table]
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SchemaError(f"{table}: missing columns {missing}")
    wrong = F.max((F.col("TARGET").isNotNull() & ~F.col("TARGET").isin(0, 1)).cast("int")) if "TARGET" in df.columns else F.lit(0)
    if not key and "TARGET" not in df.columns:
        return df
    counted = df.groupBy(key).agg(F.count("*").alias("n"), wrong.alias("wrong")) if key else df.agg(F.lit(1).alias("n"), wrong.alias("wrong"))
    row = counted.agg(F.max("n").alias("n"), F.max("wrong").alias("wrong")).first()
    if (row.n or 0) > 1:
        raise SchemaError(f"{table}: repeated {key}")
    if row.wrong:
        raise SchemaError(f"{table}: TARGET must be 0 or 1")
    return df


def load_table(spark: SparkSession, table: str, folder: str | None = None, rows: int | None = None, check: bool = True, columns: list[str] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """One table by name or alias, from ``folder`` itself or, if its file isn't there, from wherever it is below.

    ``columns`` reads these alone and is not validated beyond them; ``ids`` (a frame with the table's client or loan id)
    keeps the rows of those ids, see ``filters.rows_of``.
    """
    name = table_names(table)[0]
    place = find_folder(folder)
    path = f"{place}/{TABLES[name][0]}"
    if "://" not in path and not os.path.exists(path):
        path = detect_folder(place).get(name, "")
        if not path:
            raise FileNotFoundError(f"{name}: no file {TABLES[name][0]} in or below {place}")
    key = ids.columns[0] if ids is not None else None
    df = read_csv(spark, path, rows, None if columns is None else list(dict.fromkeys([*([key] if key else []), *columns])))
    if check and columns is None:
        df = validate(df, name)
    return df if ids is None else rows_of(df, key, ids, columns or df.columns)


def load_tables(spark: SparkSession, tables: str | list[str] | None = None, folder: str | None = None, rows: int | None = None) -> dict[str, DataFrame]:
    return {name: load_table(spark, name, folder, rows) for name in table_names(tables)}


def audit(tables: dict[str, DataFrame], keys: dict[str, str | None] | None = None) -> DataFrame:
    """A row per table: rows, columns, missing cells, repeated keys (NULL without a key)."""
    out = None
    for name, df in tables.items():
        key = (keys or {}).get(name, TABLES.get(name, (None, None, None))[1])
        repeats = (F.count("*") - F.count_distinct(F.coalesce(F.col(key).cast("string"), F.lit("\0")))) if key else F.lit(None).cast("long")
        missing = sum((F.coalesce(F.sum(F.col(f"`{c}`").isNull().cast("long")), F.lit(0)) for c in df.columns), F.lit(0))
        row = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), missing.cast("long").alias("missing_cells"), repeats.alias("repeated_keys"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no tables")
    return out


def distribution(df: DataFrame, column: str) -> DataFrame:
    """How many rows hold each value, and their share of all; missing is a value of its own."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("_total")).alias("share"))


def repeated_rows(df: DataFrame) -> DataFrame:
    """How many rows equal an earlier one in every column, as one row; missing values are alike."""
    each = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return each.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys stand on both sides, as one row; NULL is no key."""
    left, right = (df.select(key).where(F.col(key).isNotNull()) for df in (left, right))
    return left.intersect(right).agg(F.count("*").alias("shared"))


def missing_summary(df: DataFrame, top: int | None = None) -> DataFrame:
    """A row per column: missing_count, missing_rate, dtype; most missing first."""
    kinds = dict(df.dtypes)
    row = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(c) for c in df.columns])
    long = row.unpivot(["n"], df.columns, "column", "missing_count")
    kind = F.create_map(*[F.lit(x) for c in df.columns for x in (c, kinds[c])])
    out = long.select("column", "missing_count", F.try_divide("missing_count", "n").alias("missing_rate"), kind[F.col("column")].alias("dtype")).orderBy(F.desc("missing_count"), "column")
    return out.limit(top) if top else out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Load tables and print their audit.")
    parser.add_argument("folder", nargs="?")
    parser.add_argument("--tables", nargs="*", default=None)
    parser.add_argument("--rows", type=int)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("audit").getOrCreate()
    audit(load_tables(spark, given.tables, given.folder, given.rows)).show(truncate=False)


if __name__ == "__main__":
    main()
