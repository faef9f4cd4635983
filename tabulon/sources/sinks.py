"""Sinks: cleaned tables and exports (K1-K4).

Writes are ordinary Spark writers, one file per task; nothing is gathered on
the driver except the query-pack text (a handful of lines).  A folder that is
replaced is written beside its place first and then put there, so a write that
fails, or reads what it replaces, leaves the old one whole.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def swap_in(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Run `write` on a folder beside `path` and put it in the place of `path` once it is complete."""
    path = path.rstrip("/")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    target, staged, old = (jvm_path(f"{path}{end}") for end in ("", f"-staged-{uuid.uuid4().hex[:8]}", f"-old-{uuid.uuid4().hex[:8]}"))
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        write(staged.toString())
    except Exception:
        fs.delete(staged, True)
        raise
    replaced = fs.exists(target)
    if replaced and not fs.rename(target, old):
        fs.delete(staged, True)
        raise OSError(f"{path} can't be moved away")
    if not fs.rename(staged, target):
        if replaced:
            fs.rename(old, target)
        raise OSError(f"{path} can't be put in its place")
    if replaced:
        fs.delete(old, True)
    return path


def write_csv(df: DataFrame, path: str, sep: str = ",", quote_all: bool = False, mode: str = "overwrite",
              encoding: str = "utf-8") -> str:
    """K1 (and K4 with ``quote_all``: every field quoted); embedded quotes are doubled, blanks around values stay."""
    def write(to: str, how: str = "error") -> None:
        w = df.write.mode(how).option("header", True).option("sep", sep).option("escape", '"').option("quoteAll", quote_all)
        w = w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        w.option("encoding", {"latin-1": "ISO-8859-1"}.get(encoding, encoding)).csv(to)

    if mode == "overwrite":
        return swap_in(df.sparkSession, path, write)
    write(path, mode)
    return path


def save_table(df: DataFrame, name: str | None = None, path: str | None = None, mode: str = "overwrite",
               fmt: str = "parquet") -> str:
    """K2: replace a saved table (catalog table by ``name``, or files at ``path``)."""
    if name:
        df.write.mode(mode).format(fmt).saveAsTable(name)
        return name
    if not path:
        raise ValueError("save_table needs a name or a path")
    if mode == "overwrite":
        return swap_in(df.sparkSession, path, lambda to: df.write.format(fmt).save(to))
    df.write.mode(mode).format(fmt).save(path)
    return path


def pack_sql_text(results: dict, source: str, table: str, now: _dt.datetime | None = None) -> str:
    """K3 text: what the pack was made from, then each query that ran, with its title and purpose as comments."""
    made = (now or _dt.datetime.now()).isoformat(sep=" ", timespec="minutes")
    blocks = [f"-- Query pack over {table} (from {source}), written {made}"]
    blocks += [f"-- {r.title}: {r.desc}\n{r.sql.strip().rstrip(';')};" for r in results.values() if not r.error]
    return "\n\n".join(blocks) + "\n"


def export_pack_sql(spark: SparkSession, results: dict, path: str, source: str, table: str) -> str:
    """K3: write the pack text as one text file (the pack has at most 16 queries)."""
    text = pack_sql_text(results, source, table)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path
