"""Reports that are published together: readers find the old set or the new one, whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tidemark.sinks.tables import REPORT_NAMES, write_report

Reports = Iterable[tuple[str, DataFrame]]


def new_version() -> str:
    """Names of later versions sort behind those of earlier ones."""
    return f"{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}_{uuid.uuid4().hex[:8]}"


class ReportFolder:
    """A folder with versions of the reports, and a pointer to the one that counts.

    ``versions/<version>/<report>`` holds the reports; the file ``current`` names the
    version and its format. It is replaced by a rename, after all reports of the new
    version are there; until then, and after a failure, it names the old one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.folder).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.fs.Path(name)

    def _text(self, path: str) -> str | None:
        if not self._files.exists(self._path(path)):
            return None
        stream = self._files.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def current(self) -> dict[str, str] | None:
        """``version`` and ``format`` of the reports that count; None before the first are published."""
        told = self._text(f"{self.folder}/current")
        return json.loads(told) if told else None

    def read(self, report: str) -> DataFrame:
        """A report of the current version, such as ``InfoHour``."""
        now = self.current()
        if now is None:
            raise FileNotFoundError(f"no reports are published in {self.folder}")
        reader = self._spark.read.format(now["format"]).option("header", True)
        return reader.load(f"{self.folder}/versions/{now['version']}/{report}")

    def publish(self, reports: Reports, fmt: str = "parquet", keep: int = 1) -> list[str]:
        """Write the reports as a new version, then let it count; ``keep`` earlier versions stay for their readers.

        If a report fails, what was written of the version goes and the old one counts on.
        """
        version, written = new_version(), []
        try:
            for name, report in reports:
                written.append(f"{self.folder}/versions/{version}/{name}")
                write_report(report, path=written[-1], fmt=fmt)
            self._switch({"version": version, "format": fmt})
        except BaseException:
            self._files.delete(self._path(f"{self.folder}/versions/{version}"), True)
            raise
        self._tidy(version, keep)
        return written

    def _switch(self, now: dict[str, str]) -> None:
        waiting = self._path(f"{self.folder}/.current-{now['version']}")
        stream = self._files.create(waiting, True)
        try:
            stream.write(json.dumps(now).encode())
        finally:
            stream.close()
        replace = self._spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 1)
        replace[0] = self._hadoop.fs.Options.Rename.OVERWRITE
        context = self._hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        context.rename(waiting, self._path(f"{self.folder}/current"), replace)

    def versions(self) -> list[str]:
        """All versions that are there, the oldest first."""
        folder = self._path(f"{self.folder}/versions")
        if not self._files.exists(folder):
            return []
        return sorted(status.getPath().getName() for status in self._files.listStatus(folder))

    def _tidy(self, version: str, keep: int) -> None:
        earlier = [v for v in self.versions() if v < version]
        for old in earlier[: max(0, len(earlier) - keep)]:
            self._files.delete(self._path(f"{self.folder}/versions/{old}"), True)


class ReportViews:
    """Catalog views named as the reports, over tables of one version each.

    The tables of a version are written under names of their own. Only when all
    are there the views are switched, one statement each; a failure on the way
    switches those back that had been switched.
    """

    MARK = "tidemark.version"

    def __init__(self, spark: SparkSession, prefix: str):
        self._spark, self.prefix = spark, prefix

    def _table(self, report: str, version: str) -> str:
        return f"{self.prefix}{report}_v{version}"

    def current(self, report: str) -> str | None:
        """The version that a report's view shows; None without a view."""
        name = f"{self.prefix}{report}"
        if not self._spark.catalog.tableExists(name):
            return None
        if self._spark.catalog.getTable(name).tableType != "VIEW":
            raise ValueError(f"{name} is a table; reports that are published as a set need names of their own")
        marks = {r["key"]: r["value"] for r in self._spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        return marks.get(self.MARK)

    def _show(self, report: str, version: str | None) -> None:
        name = f"{self.prefix}{report}"
        if version is None:
            self._spark.sql(f"DROP VIEW IF EXISTS {name}")
            return
        columns = f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('{self.MARK}' = '{version}')"
        self._spark.sql(f"{columns} AS SELECT * FROM {self._table(report, version)}")

    def publish(self, reports: Reports, fmt: str = "parquet", keep: int = 1) -> list[str]:
        version = new_version()
        before = {name: self.current(name) for name in REPORT_NAMES.values()}
        written: list[str] = []
        try:
            for name, report in reports:
                written.append(name)
                write_report(report, table=self._table(name, version), fmt=fmt)
            for k, name in enumerate(written):
                try:
                    self._show(name, version)
                except BaseException:
                    for switched in written[:k]:
                        self._show(switched, before[switched])
                    raise
        except BaseException:
            for name in written:
                self._spark.sql(f"DROP TABLE IF EXISTS {self._table(name, version)}")
            raise
        for name in written:
            self._tidy(name, version, keep)
        return [f"{self.prefix}{name}" for name in written]

    def _tidy(self, report: str, version: str, keep: int) -> None:
        database, _, begin = self._table(report, "").rpartition(".")
        place = f" IN {database}" if database else ""
        names = [r["tableName"] for r in self._spark.sql(f"SHOW TABLES{place} LIKE '{begin}*'").collect()]
        newest = f"{begin}{version}".lower()
        earlier = sorted(n for n in names if n.lower() < newest)
        for old in earlier[: max(0, len(earlier) - keep)]:
            self._spark.sql(f"DROP TABLE IF EXISTS {database + '.' if database else ''}{old}")
