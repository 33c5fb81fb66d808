"""Report and history documents: scans that pass over what cannot be read, and the writers of reports and period files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col
#: The columns of a report document that are read; ``backtest`` and ``daily_signal`` stay text.
REPORT = "schema_version int, date string, generated_at_utc string, backtest string, daily_signal string, fetch string, slack_fallback_text string"
HISTORY = "date string, jst_date string, summary string, llm_status string, report string"


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Report documents (a file each) by falling date; a file that is no JSON object is passed over."""
    rows = spark.read.text(folder, wholetext=True).select(F.from_json("value", REPORT).alias("r"), "_metadata.file_path").select("r.*", "file_path")
    return rows.where("date is not null").orderBy(F.desc("date"), "file_path").drop("file_path")


def history(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Lines of a JSON history, newest first; blank and broken lines are passed over.  ``limit`` keeps the last ones."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", HISTORY).alias("h"), F.monotonically_increasing_id().alias("at"))
    rows = rows.where("h.date is not null").orderBy(F.desc("at"))
    return (rows if limit is None else rows.limit(limit)).select("h.*")


def plain(df: DataFrame) -> DataFrame:
    """Doubles that are not a number or infinite become null, in structs, arrays and maps too."""

    def clean(x, kind: T.DataType):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
        if isinstance(kind, T.StructType):
            return F.when(x.isNotNull(), F.struct(*[clean(x[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(x, lambda v: clean(v, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(x, lambda _, v: clean(v, kind.valueType))
        return x

    return df.select(*[clean(c(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def report_documents(parts: DataFrame, version: int = 1, dropped: tuple[str, ...] = ("log", "raw_signal_json"), keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, date and document (JSON): schema_version, date, and the other columns of ``parts`` but for the dropped ones.

    Nulls stay in the document; dates are text, as JSON has them.
    """
    rows = plain(parts.drop(*dropped))
    rest = [x for x in rows.columns if x not in ("date", *keys)]
    return rows.select(*keys, "date", F.to_json(F.struct(F.lit(version).alias("schema_version"), c("date").cast("string").alias("date"), *rest), {"ignoreNullFields": "false"}).alias("document"))


def write_reports(documents: DataFrame, folder: str) -> None:
    """Documents as text, in a folder for each date; those of the dates given are replaced."""
    documents.select("date", c("document").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").text(folder)


def write_periods(rows: DataFrame, folder: str) -> None:
    """CSV files with a header in a folder for each period; what is missing is ``NA``."""
    rows.write.mode("overwrite").partitionBy("period_label").option("header", True).option("nullValue", "NA").csv(folder)


def write_returns(days: DataFrame, folder: str) -> None:
    """The strategy's returns of a report (date, ret_sub) as JSON, a row a line."""
    days.select("date", "ret_sub").write.mode("overwrite").json(folder)


def report_returns(spark: SparkSession, folder: str) -> DataFrame | None:
    """date, ret_sub of a written report; None if there is none.  Rows that cannot be read are passed over."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("date date, ret_sub double").json(folder).where("date is not null")


#: The files of a report set.
MANIFEST = "run string, table string, period_label string, rows long"


class ReportSet:
    """Tables of one run, split by period, that readers see all at once.

    Each run writes its tables, with the column period_label, to a folder of its own, a folder for each period in each
    table; then its manifest, one row for each table and period, replaces the one before, and the tables that it named go.
    A run that fails leaves the last manifest, and what it names, as they were.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> DataFrame | None:
        path, files = self._path("manifest")
        return self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest") if files.exists(path) else None

    def publish(self, tables: dict[str, DataFrame], run: str) -> DataFrame:
        """Writes the tables as CSV (missing values are ``NA``) and names them; the manifest's rows."""
        before = self.manifest()
        old = {r.run for r in before.select("run").distinct().collect()} if before is not None else set()
        if run in old:
            raise ValueError(f"run {run!r} is published already")
        named = None
        for name, rows in tables.items():
            rows.hint("rebalance", "period_label").write.mode("overwrite").partitionBy("period_label").option("header", True).option("nullValue", "NA").csv(f"{self.folder}/{run}/{name}")
            written = self.spark.read.option("header", True).option("nullValue", "NA").csv(f"{self.folder}/{run}/{name}")
            part = written.groupBy("period_label").agg(F.count("*").alias("rows")).select(F.lit(run).alias("run"), F.lit(name).alias("table"), c("period_label").cast("string").alias("period_label"), "rows")
            named = part if named is None else named.unionByName(part)
        named.coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest-{run}")  # a few rows
        path, files = self._path("manifest")
        fresh, _ = self._path(f"manifest-{run}")
        files.delete(path, True)
        files.rename(fresh, path)
        for gone in old:
            files.delete(self._path(gone)[0], True)
        return self.manifest()

    def read(self, table: str, period: str) -> DataFrame:
        """One table of one period, as the manifest names it."""
        found = self.manifest()
        runs = [r.run for r in found.where((c("table") == table) & (c("period_label") == period)).collect()] if found is not None else []
        if not runs:
            raise ValueError(f"no table {table!r} for {period!r}")
        return self.spark.read.option("header", True).option("nullValue", "NA").option("inferSchema", True).csv(f"{self.folder}/{runs[0]}/{table}/period_label={period}")


def write_day(signals: DataFrame, regime: DataFrame, folder: str) -> None:
    """The signals (CSV) and the regime (JSON) of each processed date, in folders by date; a date is replaced."""
    signals.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").option("header", True).csv(f"{folder}/signals")
    regime.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").json(f"{folder}/regime")


def last_closes(panel: DataFrame, positions: DataFrame) -> DataFrame:
    """For each long position the last close up to its date, the one before and the change in per cent."""
    w = Window.partitionBy("universe_id", "ticker").orderBy("date")
    closes = panel.where("close is not null").withColumn("previous", F.lag("close").over(w)).select("universe_id", "date", "ticker", "close", "previous")
    rows = positions.where("position = 'LONG'").select("universe_id", "date", "ticker").join(closes, ["universe_id", "date", "ticker"])
    return rows.withColumns({"change_pct": (c("close") / c("previous") - 1) * 100, "execution_date": F.date_add("date", 1)})
