"""Scans: headered text tables with sniffed encoding and delimiter.

Everything reads through Spark's own sources, split across tasks; only a
few header/sample lines (bounded) come to the driver for sniffing.

A folder is read by a scan plan: one distributed pass over the raw lines finds
the files that are not UTF-8 and those in which a quoted field spans lines.
The rest, mostly everything, goes to Spark's CSV source as it is; files of
another encoding go there with that encoding; files with line breaks in quotes
are cut into records by `tabulon.sources.records`, split across tasks too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.numeric import ROW_ID, fails_number, fails_timestamp, q
from tabulon.operators.ordering import FILE, POS, START, number_rows, scan_order, scan_place
from tabulon.sources.records import balanced_files, open_line, read_records

# Candidate delimiters, in tie-break order.
DELIMITERS = [",", ";", "\t", "|"]
# pandas' default missing-value tokens.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
SAMPLE_BYTES = 4096
MAX_COLUMNS = 200_000
_EXTRA = "__extra_field"
# A null marker no real field holds, so empty fields stay "" until S6 decides.
_NO_NULL = "\u0000\u0001no-null\u0001\u0000"
_SPARK_ENCODING = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}


def detect_encoding(spark: SparkSession, path: str) -> str:
    """S3: ``utf-8`` when every line is valid UTF-8, else ``latin-1`` (which decodes any bytes).

    The text source keeps each line's raw bytes, so the check is one
    distributed filter that stops at the first bad line.
    """
    bad = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return "latin-1" if bad else "utf-8"


def literal_path(name: str) -> str:
    """A file as Spark names it (an encoded URI, with or without the empty authority) as a path its readers take literally."""
    return re.sub(r"([][{}*?\\])", r"\\\1", unquote(re.sub(r"^(\w+):///", r"\1:/", name)))


def input_files(spark: SparkSession, path: str) -> list[str]:
    """The files under a path in order of their names."""
    return sorted(map(literal_path, spark.read.text(path).inputFiles()))


@dataclass
class ScanPart:
    """Files that are read alike; `records`: quoted fields span lines in them."""
    paths: list[str]
    encoding: str
    records: bool = False


def scan_plan(spark: SparkSession, path: str, sep: str, encoding: str | None = None) -> list[ScanPart]:
    """Which files of a folder need another encoding, or records cut by their quotes (in pieces of at most two
    by two kinds).  Only the names of files that differ from the rest come to the driver, beside Spark's own listing."""
    line = F.col("value")
    odd = {r["file"]: r for r in spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), (~F.is_valid_utf8(line)).alias("latin"), open_line(line, sep).alias("open"))
        .where("latin OR open").groupBy("file").agg(F.max("latin").alias("latin"), F.max("open").alias("open")).collect()}
    if not odd:
        return [ScanPart([path], encoding or "utf-8")]
    kind = {literal_path(f): (encoding or ("latin-1" if r["latin"] else "utf-8"), r["open"]) for f, r in odd.items()}
    several = [f for f, (_, is_open) in kind.items() if is_open]
    # A quote that is never closed is a stray one: such a file is read line by line.
    whole = {literal_path(f) for f in balanced_files(spark, several, sep)} if several else set()
    parts: dict[tuple[str, bool], list[str]] = {}
    for f in input_files(spark, path):
        enc, _ = kind.get(f, (encoding or "utf-8", False))
        parts.setdefault((enc, f in whole), []).append(f)
    return [ScanPart(files, enc, records) for (enc, records), files in parts.items()]


def _sample(spark: SparkSession, path: str, nbytes: int = SAMPLE_BYTES) -> str:
    lines, size = [], 0
    for row in spark.read.text(path).limit(256).collect():
        lines.append(row["value"])
        size += len(row["value"]) + 1
        if size >= nbytes:
            break
    return "\n".join(lines)[:nbytes]


def detect_delimiter(sample: str) -> str:
    """The most frequent candidate in the sample; ties go to the earlier candidate."""
    counts = [sample.count(d) for d in DELIMITERS]
    return DELIMITERS[counts.index(max(counts))]


def safe_name(name: str) -> str:
    """Trim, then every character outside ``[a-zA-Z0-9_]`` becomes ``_``."""
    return re.sub(r"[^a-zA-Z0-9_]", "_", str(name).strip())


def safe_names(names: list[str]) -> list[str]:
    """S7 for a whole header; a clash gets a ``_2``, ``_3``... suffix (the reference does not de-collide)."""
    out, seen = [], set()
    for n in names:
        base = safe_name(n)
        cand, k = base, 2
        while cand in seen:
            cand, k = f"{base}_{k}", k + 1
        seen.add(cand)
        out.append(cand)
    return out


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*safe_names(df.columns))


def _header(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str]:
    """Names from the whole first record of a file, decoded like the data."""
    row = _reader(spark, sep, encoding, True).option("header", False).csv(path).first()
    first = ["" if v is None else v for v in row] if row is not None else []
    names, seen = [], {}
    for i, n in enumerate(first):
        n = n if n != "" else f"Unnamed: {i}"
        if n in seen:                      # pandas mangles duplicate headers as name.1, name.2
            seen[n] += 1
            n = f"{n}.{seen[n]}"
        else:
            seen[n] = 0
        names.append(n)
    return names


def _options(sep: str) -> dict[str, str]:
    """Standard quoting: a quote inside quotes is doubled, a backslash is an ordinary character."""
    return {"sep": sep, "quote": '"', "escape": '"', "maxColumns": str(MAX_COLUMNS), "mode": "PERMISSIVE",
            "nullValue": _NO_NULL, "emptyValue": ""}


def _reader(spark: SparkSession, sep: str, encoding: str, multi_line: bool = False):
    return (spark.read.options(**_options(sep)).option("encoding", _SPARK_ENCODING.get(encoding, encoding))
            .option("multiLine", multi_line))


def _fields(names: list[str]) -> T.StructType:
    return T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(_EXTRA, T.StringType())])


def read_lenient(spark: SparkSession, path: str, sep: str, encoding: str | None = None, multi_line: bool = False,
                 row_ids: bool = False) -> DataFrame:
    """All-text read; short rows are padded with nulls, rows with too many fields are skipped.

    The schema has one spare field: a row that fills it had too many fields
    and is dropped (``DROPMALFORMED`` would also drop short rows).  Missing
    tokens become null afterwards (Spark itself reads ``NA`` as text).
    Line breaks inside quotes are found by the scan plan; ``multi_line`` skips
    the plan and has each file read whole by one task.  ``row_ids`` adds the
    place of each row in its file, for :func:`read_csv`.
    """
    files = input_files(spark, path)
    parts = ([ScanPart([path], encoding or detect_encoding(spark, path))] if multi_line
             else scan_plan(spark, path, sep, encoding))
    first = next((p.encoding for p in parts if files[:1] and files[0] in p.paths), parts[0].encoding)
    names = _header(spark, files[0], sep, first) if files else []
    schema, frames = _fields(names), []
    for part in parts:
        if part.records:
            rows = read_records(spark, part.paths, sep, _SPARK_ENCODING.get(part.encoding, part.encoding))
            raw = (rows.where((F.col(START) > 0) | (F.col(POS) > 0))         # the first record of a file is its header
                       .select(F.from_csv("record", _ddl(schema), _options(sep) | {"multiLine": "true"}).alias("r"),
                               *([FILE, START, POS] if row_ids else []))
                       .select("r.*", *([FILE, START, POS] if row_ids else [])))
        else:
            raw = (_reader(spark, sep, part.encoding, multi_line).schema(schema)
                   .option("header", True).option("enforceSchema", True).csv(part.paths))
        kept = raw.where(F.col(_EXTRA).isNull()).drop(_EXTRA)
        kept = scan_place(kept) if row_ids and not part.records else kept
        frames.append(kept.select(*[F.when(q(c).isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(q(c)).alias(c) for c in names],
                                  *([FILE, START, POS] if row_ids else [])))
    out = frames[0]
    for other in frames[1:]:
        out = out.union(other)
    return out


def _ddl(schema: T.StructType) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` STRING" for f in schema.fields)


def infer_types(df: DataFrame, dates: bool = True) -> DataFrame:
    """S1 type inference over all rows: long, double, boolean, date, timestamp, else text.

    Two aggregates: the cheap numeric/boolean checks for every text column,
    then the (costlier) date parses only for columns that are still text.
    """
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        v, nn = q(c), q(c).isNotNull()
        aggs += [F.count_if(fails_number(v, "long")).alias(f"l{i}"),
                 F.count_if(fails_number(v, "double")).alias(f"d{i}"),
                 F.count_if(nn & ~F.lower(v).isin("true", "false")).alias(f"b{i}"),
                 F.count(v).alias(f"n{i}")]
    row = df.agg(*aggs).first()
    kind = {}
    for i, c in enumerate(cols):
        if row[f"n{i}"] == 0:
            kind[c] = "empty"
        elif row[f"l{i}"] == 0:
            kind[c] = "long"
        elif row[f"d{i}"] == 0:
            kind[c] = "double"
        elif row[f"b{i}"] == 0:
            kind[c] = "bool"
    text = [c for c in cols if c not in kind]
    if dates and text:
        drow = df.agg(*[x for i, c in enumerate(text) for x in (
            F.count_if(fails_timestamp(q(c), "yyyy-MM-dd")).alias(f"t{i}"),
            F.count_if(fails_timestamp(q(c))).alias(f"s{i}"))]).first()
        for i, c in enumerate(text):
            if drow[f"t{i}"] == 0:
                kind[c] = "date"
            elif drow[f"s{i}"] == 0:
                kind[c] = "timestamp"
    out = []
    for f in df.schema.fields:
        v, k = q(f.name), kind.get(f.name)
        if k == "empty":
            out.append(v.cast("double").alias(f.name))          # an all-missing column reads as float
        elif k in ("long", "double"):
            out.append(v.try_cast(k).alias(f.name))
        elif k == "bool":
            out.append((F.lower(v) == "true").alias(f.name))
        elif k == "date":
            out.append(F.try_to_date(v, "yyyy-MM-dd").alias(f.name))
        elif k == "timestamp":
            out.append(F.try_to_timestamp(v).alias(f.name))
        else:
            out.append(v)
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
             infer: bool = True, clean_names: bool = False, dates: bool = True,
             multi_line: bool = False, row_ids: bool = False) -> DataFrame:
    """S1 (+S3-S7): headered delimited text with sniffed encodings/delimiter, lenient rows, NA tokens.

    ``row_ids`` adds ``_row_id``, 0, 1, ... in file order (files by name); the
    rows are written once for it, so that ids and rows stay together.
    """
    files = input_files(spark, path)
    delim = sep or detect_delimiter(_sample(spark, files[0] if files else path))
    df = read_lenient(spark, path, delim, encoding, multi_line, row_ids)
    if row_ids:
        df = number_rows(df, ROW_ID)
    if infer:
        df = infer_types(df, dates=dates)
    return clean_column_names(df) if clean_names else df


def limit_rows(df: DataFrame, n: int = 100_000, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows in ``order_by`` order, by ``_row_id`` or else in the order of the scan."""
    if order_by:
        return df.orderBy(*[q(c) for c in order_by]).limit(n)
    if ROW_ID in df.columns:
        return df.orderBy(ROW_ID).limit(n)
    return scan_order(df).orderBy(ROW_ID).limit(n).drop(ROW_ID)
