"""Report sinks: replace a folder, or the rows of a catalog table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the published report names
REPORT_NAMES = {
    "report_hour": "InfoHour",
    "report_level": "InfoOO",
    "report_level_range": "InfoGroup",
    "store_suggestions": "Impacts",
}


def write_report(df: DataFrame, path: str | None = None, table: str | None = None, fmt: str = "parquet") -> None:
    """Replace the report at ``path``, or the rows of the catalog ``table``, which is made if it is not there."""
    if (path is None) == (table is None):
        raise ValueError("give either a path or a table")
    if table is not None and df.sparkSession.catalog.tableExists(table):
        overwrite_rows(df, table)
        return
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if table is not None:
        writer.saveAsTable(table)
    else:
        writer.save(path)


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def overwrite_rows(df: DataFrame, table: str) -> None:
    """Replace all rows of an existing table, which keeps its columns, comments, properties and grants.

    The report's columns are matched by name and must be those of the table, with
    the same types. Levels are the exception, columns named by a number: a level
    that is new is added behind the table's columns, and one that no longer occurs
    stays and is empty. Any other difference is refused before anything is written.
    """
    spark = df.sparkSession
    if spark.catalog.getTable(table).tableType == "VIEW":
        raise ValueError(f"{table} is a view; it may belong to reports that are published as a set")
    there = {f.name: f.dataType for f in spark.table(table).schema.fields}
    ours = {f.name: f.dataType for f in df.schema.fields}
    new = [c for c in ours if c not in there]
    gone = [c for c in there if c not in ours]
    other = [c for c in ours if c in there and ours[c] != there[c]]
    refused = [c for c in (*new, *gone) if not c.isdecimal()] + other
    if refused:
        raise ValueError(f"{table} has other columns than the report, or other types of them: {', '.join(refused)}")
    if new:
        added = ", ".join(f"{_quoted(c)} {ours[c].simpleString()}" for c in new)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({added})")
    order = [*there, *new]
    filled = [F.col(_quoted(c)) if c in ours else F.lit(None).cast(there[c]).alias(c) for c in order]
    df.select(*filled).write.insertInto(table, overwrite=True)
