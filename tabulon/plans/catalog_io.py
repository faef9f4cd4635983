"""Registered scan/sink queries: the sales view written by Spark and read back through the sniffing scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.numeric import ROW_ID
from tabulon.plans import fixtures as fx
from tabulon.plans.catalog import register, with_sales
from tabulon.session import scratch_path
from tabulon.sources.csv import NA_TOKENS, read_csv
from tabulon.sources.sinks import write_csv

_ROUNDTRIP_SQL = with_sales("""
SELECT order_id, CAST(line_no AS BIGINT) AS line_no, ship_date, category, region, segment, quantity, revenue, cost
FROM sales""")


def _roundtrip(sep: str, quote_all: bool = False):
    def run(spark, d):
        path = scratch_path(spark, "sales-csv")
        write_csv(fx.sales(spark, d), path, sep=sep, quote_all=quote_all)
        return read_csv(spark, path)
    return run


register("csv_roundtrip_semicolon", _ROUNDTRIP_SQL)(_roundtrip(";"))
register("csv_roundtrip_quoted", _ROUNDTRIP_SQL)(_roundtrip(",", quote_all=True))


# ------------------------------------------------------------------ texts with quotes, delimiters and line breaks

_NA = ", ".join("'" + t + "'" for t in NA_TOKENS)
_DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]
_DOCUMENTS_SQL = f"""
SELECT doc_id, CASE WHEN text NOT IN ({_NA}) THEN text END AS text, CASE WHEN lang NOT IN ({_NA}) THEN lang END AS lang,
       CASE WHEN source NOT IN ({_NA}) THEN source END AS source, CAST(n_chars AS BIGINT) AS n_chars FROM documents"""


def _documents(spark, d):
    return fx.table(spark, d, "documents").select(*_DOC_COLS)


def _dirty(spark, d):
    """Whole texts, line breaks and quotes included, through the default CSV sink and scan."""
    path = scratch_path(spark, "documents-csv")
    write_csv(_documents(spark, d), path)
    return read_csv(spark, path)


def _mixed(spark, d):
    """A folder of files in two encodings: texts that Latin-1 holds, and the others."""
    path = scratch_path(spark, "documents-mixed")
    docs, narrow = _documents(spark, d), F.coalesce(F.concat_ws("", "text", "lang", "source").rlike(r"^[\x00-\xFF]*+\z"), F.lit(True))
    write_csv(docs.where(narrow), path, sep=";", encoding="latin-1")
    write_csv(docs.where(~narrow), path, sep=";", mode="append")
    return read_csv(spark, path, sep=";")


def _row_ids(spark, d):
    """Row ids of a folder whose files hold consecutive ranges."""
    path = scratch_path(spark, "events-csv")
    write_csv(fx.table(spark, d, "events").select("event_id", "user_id", "event_type").orderBy("event_id"), path)
    return read_csv(spark, path, row_ids=True).withColumnRenamed(ROW_ID, "row_id")


register("csv_dirty_documents", _DOCUMENTS_SQL)(_dirty)
register("csv_mixed_encodings", _DOCUMENTS_SQL)(_mixed)
register("csv_row_ids", """
SELECT event_id, user_id, event_type, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS row_id FROM events""")(_row_ids)
