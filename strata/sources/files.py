"""File sources: dated templates, formats, records as rows, new files only, manifests."""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import itertools
import posixpath
import re
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import cut

#: Columns that a source without a schema may have.
MAX_COLUMNS = 10_000

#: Date letters and their form; units of an offset; texts that are null; suffixes of formats.
LETTERS = {"yyyy": "%Y", "yy": "%y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S"}
UNITS = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}
NULLS = ("", "NULL", "null")
FORMATS = {"csv": "csv", "tsv": "csv", "jsonl": "json", "ndjson": "json", "json": "document", "parquet": "parquet"}


def render(template: str, at: datetime) -> str:
    """Expands {yyyyMMdd}, {yyyy-MM}, {yyyyMMdd-1d}; letters that aren't dates are an error."""

    def one(m: re.Match) -> str:
        body, when = m[1], at
        if shift := re.search(r"([+-])(\d+)([mhdw])$", body):
            delta = timedelta(**{UNITS[shift[3]]: int(shift[2])})
            body, when = body[: shift.start()], at + delta if shift[1] == "+" else at - delta
        out, i = [], 0
        while i < len(body):
            token = next((t for t in LETTERS if body.startswith(t, i)), None)
            if token:
                out.append(when.strftime(LETTERS[token]))
                i += len(token)
            elif body[i].isalpha():
                raise ValueError(f"unknown date letters in {{{m[1]}}}")
            else:
                out.append(body[i])
                i += 1
        if not any(t in body for t in LETTERS):
            raise ValueError(f"no date in {{{m[1]}}}")
        return "".join(out)

    return re.sub(r"\{([^{}]*)\}", one, template)


def resolve(base: str, template: str, at: datetime) -> str:
    """A rendered glob under the base path; one that leaves it is an error."""
    path = posixpath.normpath(posixpath.join(base, render(template, at).lstrip("/")))
    if path != base.rstrip("/") and not path.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"{template} leaves {base}")
    return path


def infer_format(path: str) -> str:
    """csv, json, document or parquet, from the suffix, with or without .gz."""
    suffix = path.removesuffix(".gz").rsplit(".", 1)[-1].rstrip("*").lower()
    if suffix not in FORMATS:
        raise ValueError(f"unknown format: {path}")
    return FORMATS[suffix]


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, quote: str = '"', header: bool = True, skip_rows: int = 0, encoding: str = "UTF-8", infer: bool = True) -> DataFrame:
    """Rows of CSV or TSV files; "", NULL and null are null; types are inferred from what is left."""
    sep = delimiter or ("\t" if re.search(r"\.tsv(\.gz)?\*?$", path) else ",")
    if skip_rows:
        df = _skipping(spark, path, sep, quote, header, skip_rows, encoding)
    else:
        df = spark.read.options(sep=sep, quote=quote, encoding=encoding, header=str(header).lower()).csv(path)
    df = df.select(*(F.when(~F.col(f"`{c}`").isin(*NULLS), F.col(f"`{c}`")).alias(c) for c in df.columns))
    if not infer:
        return df
    tests = [F.struct(*(F.every(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast(t).isNotNull()).alias(t) for t in ("bigint", "double", "boolean", "date", "timestamp"))).alias(c) for c in df.columns]
    fits = df.agg(*tests).first() if df.columns else {}
    kind = {c: next((t for t in ("bigint", "double", "boolean", "date", "timestamp") if fits[c] is not None and fits[c][t]), "string") for c in df.columns}
    return df.select(*(F.col(f"`{c}`").try_cast(kind[c]).alias(c) for c in df.columns))


def _skipping(spark: SparkSession, path: str, sep: str, quote: str, header: bool, skip: int, encoding: str) -> DataFrame:
    """Rows of CSV files whose first lines are no data; columns go by the name in the file's own header.

    A file is one stream, read in small buffers by one task (a quoted line end may stand anywhere in it), and rows leave as
    they are read, so memory doesn't grow with the file.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in (x for b in batches for x in b.column(0).to_pylist()):
            with _stream(name) as raw, gzip.open(raw) if name.endswith(".gz") else raw as plain, io.TextIOWrapper(plain, encoding, newline="") as text:
                for _ in range(skip):
                    text.readline()
                lines = csv.reader(text, delimiter=sep, quotechar=quote)
                names = next(lines, None) if header else None
                full = (list(zip(names or [f"_c{k}" for k in range(len(x))], x)) for x in lines if x)
                while some := list(itertools.islice(full, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.map_(pa.string(), pa.string()))], ["m"])

    made = cut(_each_file(listing(spark, path)).mapInArrow(rows, "m map<string,string>"))
    first = made.select(F.posexplode(F.map_keys("m")).alias("at", "name")).groupBy("name").agg(F.min("at").alias("at"))
    names = [r.name for r in first.orderBy("at", "name").limit(MAX_COLUMNS + 1).collect()]
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")
    return made.select(*(F.col("m")[n].alias(n) for n in names))


def _stream(path: str):
    """A file's bytes as a buffered stream, by whatever file system its path names."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return io.BufferedReader(system.open_input_stream(place, compression=None), 1 << 20)


def _each_file(files: DataFrame) -> DataFrame:
    """Their paths, dealt out so that a task has few."""
    return files.select("path").repartition(max(1, min(10_000, files.count())), "path")


def digests(files: DataFrame) -> DataFrame:
    """path, sha256 of files, read in buffers of 8 MB whatever their size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                sha = hashlib.sha256()
                with _stream(name) as f:
                    while data := f.read(8 << 20):
                        sha.update(data)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sha.hexdigest()])], ["path", "sha256"])

    return _each_file(files).mapInArrow(each, "path string, sha256 string")


def _fields(kind: str) -> dict[str, str]:
    """Names and types of an OBJECT<...> as a variant's schema says it."""
    out, depth, start, quoted = {}, 0, 0, False
    body = kind[len("OBJECT<") : -1] + ","
    for i, c in enumerate(body):
        quoted ^= c == "`"
        depth += 0 if quoted else (c in "<(") - (c in ">)")
        if c == "," and not depth and not quoted and body[start:i].strip():
            part = body[start:i].strip()
            name, of = re.fullmatch(r"(`(?:[^`]|``)*`|[^:]*): (.*)", part, re.S).groups()
            out[name[1:-1].replace("``", "`") if name.startswith("`") else name], start = of, i + 1
    return out


def normalize(records: DataFrame, column: str = "value") -> DataFrame:
    """One column per key of JSON object texts, in order of name; what isn't an object is {value: x}.

    Whole numbers, decimals and booleans keep their types where every record agrees; nested values are JSON text with
    sorted keys, absent ones null. The keys come from one aggregate, the records' common schema.
    """
    v = F.col(column)
    parsed = F.try_parse_json(v)
    object_ = F.schema_of_variant(parsed).startswith("OBJECT")
    rows = records.select(F.when(object_, parsed).otherwise(F.parse_json(F.to_json(F.struct(F.coalesce(F.variant_get(F.when(~object_, parsed), "$", "string"), v).alias("value"))))).alias("m"))
    kind = rows.agg(F.schema_of_variant_agg("m")).first()[0]
    fields = _fields(kind) if kind.startswith("OBJECT<") else {}
    if len(fields) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")

    def one(name: str, of: str) -> Column:
        path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
        plain = of in ("BIGINT", "DOUBLE", "BOOLEAN") or of.startswith("DECIMAL")
        return F.variant_get("m", path, of.lower() if plain else "string").alias(name)

    return rows.select(*(one(n, fields[n]) for n in sorted(fields)))


def flatten(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*(F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema))


def read_document(spark: SparkSession, path: str, records_key: str | None = None) -> DataFrame:
    """Rows of whole JSON documents: a list's items, or those under `records_key`, or the one object."""
    text = spark.read.text(path, wholetext=True).where(F.trim("value") != "")
    if records_key:
        text = text.select(F.get_json_object("value", f"$.{records_key}").alias("value")).where("value is not null")
    items = F.when(F.col("value").rlike(r"\A\s*\["), F.transform(F.variant_get(F.parse_json("value"), "$", "array<variant>"), lambda x: F.to_json(x))).otherwise(F.array("value"))
    return normalize(text.select(F.explode(items).alias("value")))


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    kind = infer_format(path)
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind == "document":
        return read_document(spark, path, **options)
    return spark.read.json(path) if kind == "json" else spark.read.parquet(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified, fingerprint of the files under a glob; no content is read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.withColumn("fingerprint", F.concat_ws(":", "size", F.unix_micros("modified")))


def new_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose fingerprint isn't the stored one: new or changed."""
    return files.join(seen.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")


def manifest(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """path, size, sha256, fingerprint, rows of files; `rows` is the read frame with its _metadata."""
    n = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
    files = listing(spark, path)
    return files.join(digests(files), "path").join(n, "path", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def arrived(files: DataFrame, seen: DataFrame) -> bool:
    """Whether a matched file is new or changed: what a run on arrival asks before it starts."""
    return not new_files(files, seen).isEmpty()
