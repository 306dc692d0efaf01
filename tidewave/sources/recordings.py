"""Readers of recordings: one scan for all files of a kind and header, identity from the file name, rejects instead of failures."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File names of the recordings' formats.
NAMES = {
    "pose": r"^(\d{4})_(\d{2})_.*\.csv$",
    "ecg": r"^(\d{4})_ecg_session(\d{2})\.csv$",
    "summary": r"^(\d{4})_summary_session(\d{2})\.csv$",
    "session": r"^(\d{4})_session(\d{2})\.csv$",
}

#: Columns that a reader needs, and the timestamp formats of the devices.
NEEDED = {
    "gsr": ["Shimmer_AD66_GSR_Skin_Conductance_CAL"],
    "eye": ["R Gaze X", "R Gaze Y", "L Gaze X", "L Gaze Y", "R Pupil Size", "L Pupil Size", "Time Stamp"],
    "matb": ["scenario_time", "type", "module", "address", "value"],
    "ecg": ["Time", "EcgWaveform"],
}
TIME_FORMATS = {"ecg": "dd/MM/yyyy HH:mm:ss[.SSSSSS][.SSS]", "gsr": "yyyy/MM/dd HH:mm:ss[.SSSSSS][.SSS]"}


#: Columns of a summary that are no measurements of interest.
DROPPED = ["SkinTemp", "GSR", "BatteryVolts", "ROGState", "ROGTime", "LinkQuality", "RSSI", "TxPower", "Ext.Status", "BatteryLevel", "AuxADC1", "AuxADC2", "AuxADC3"]

#: A column that each kind's header has, by which header lines are found.
MARKS = {"pose": "x1", "summary": "HeartRate"} | {k: v[0] for k, v in NEEDED.items()}


def scan(spark: SparkSession, folder: str, kind: str, names: str = "", glob: str = "*.csv") -> DataFrame:
    """All files of a folder, as strings, with participant, trial, frame (the row's place in its file) and file.

    Files may have different headers: those with the same one are one scan, and columns that a file lacks are NULL. The
    names' pattern is that of ``names`` (by default of ``kind``, else of plain sessions); rows of files whose name
    doesn't fit have a null participant. Files without a header line give no rows. A frame follows the blocks of a file
    and the rows of a block, so it doesn't depend on how files are split.
    """
    pattern = NAMES[names or (kind if kind in NAMES else "session")]
    mark = MARKS[kind].lower()
    lines = spark.read.text(folder, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), "value")
    found = lines.where(F.exists(F.split(F.regexp_replace(F.lower("value"), "[\ufeff\"]", ""), ","), lambda c: F.trim(c) == mark)).distinct()
    headers: dict[str, list[str]] = {}
    for r in found.collect():  # a line a file, which the driver lists for a scan anyway
        headers.setdefault(r["value"], []).append(r["path"])
    parts = [spark.read.csv(sorted(paths), header=True, mode="PERMISSIVE") for paths in headers.values()]
    tagged = [_tagged(p, pattern) for p in parts]
    if not tagged:
        return spark.createDataFrame([], "file string, frame int, participant string, trial int")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)


def _tagged(raw: DataFrame, pattern: str) -> DataFrame:
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    clean = [F.col(f"`{c}`").alias(c.lstrip("\ufeff").strip()) for c in raw.columns]
    rows = raw.select(*clean, name.alias("file"), F.col("_metadata.file_block_start").alias("__block")).withColumn("__at", F.monotonically_increasing_id())
    part = Window.partitionBy("file").orderBy("__block", "__at")
    return rows.withColumns({
        "frame": F.row_number().over(part) - 1,
        "participant": F.nullif(F.regexp_extract("file", pattern, 1), F.lit("")),
        "trial": F.regexp_extract("file", pattern, 2).try_cast("int"),
    }).drop("__block", "__at")


def split_rejects(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejects by file with a reason: a name that doesn't fit, or columns that are missing from all files."""
    missing = [c for c in NEEDED.get(kind, []) if c not in df.columns]
    reason = F.when(F.col("participant").isNull(), "name").when(F.lit(bool(missing)), "columns: " + ", ".join(missing))
    judged = df.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("file", "reason").distinct()


def files_without_rows(spark: SparkSession, folder: str, scanned: DataFrame, glob: str = "*.csv") -> DataFrame:
    """Files of the folder that ``scan`` has no rows of: no header line, or nothing below it."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return listed.join(scanned.select("file").distinct(), "file", "left_anti")


def ecg_pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Waveforms and summaries of a folder, both with timestamps; of a summary the columns in ``DROPPED`` go where it has them."""
    waves = timed(scan(spark, folder, "ecg", glob="*_ecg_session*.csv"), "Time", "ecg")
    summaries = timed(scan(spark, folder, "summary", glob="*_summary_session*.csv"), "Time", "ecg")
    return numeric(waves, ["EcgWaveform"]), summaries.drop(*DROPPED)


def matb_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events and measures of the logs, with their time in seconds; other kinds of row go."""
    rows = scan(spark, folder, "matb")
    return rows.where(F.col("type").isin("event", "performance")).withColumn("scenario_time", F.col("scenario_time").try_cast("double"))


def participant_info(spark: SparkSession, folder: str, name: str = "participant_info.csv") -> DataFrame:
    """The participants' table of the folder or of its parent, its names trimmed and without a byte order mark; an error if neither has it."""
    for place in (folder.rstrip("/"), folder.rstrip("/").rsplit("/", 1)[0]):
        try:
            found = spark.read.csv(f"{place}/{name}", header=True)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        return found.select(*[F.col(f"`{c}`").alias(c.lstrip("\ufeff").strip()) for c in found.columns])
    raise FileNotFoundError(f"{name} is neither in {folder} nor in the folder above")


def feature_tables(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """Stage results to fuse; a missing one is an error that names it."""
    out = []
    for path in paths:
        try:
            out.append(spark.read.option("mergeSchema", "true").parquet(path))
        except AnalysisException as e:
            raise FileNotFoundError(path) from e
    return out


def results(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """Result documents, one row each, with the model's name from the file name."""
    found = spark.read.json(folder, multiLine=True, pathGlobFilter=glob)
    return found.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("model"))


def stage_status(spark: SparkSession, stages: dict[str, str]) -> DataFrame:
    """stage, done, files, rows of stage results by their folders; a stage that isn't there has zeros."""
    rows = []
    for stage, path in stages.items():
        try:
            table = spark.read.parquet(path)
            rows.append((stage, True, len(table.inputFiles()), table.count()))
        except AnalysisException:
            rows.append((stage, False, 0, 0))
    return spark.createDataFrame(rows, "stage string, done boolean, files int, rows long")


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; what isn't a number becomes NULL."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in columns})


def timed(df: DataFrame, column: str, kind: str) -> DataFrame:
    """``timestamp`` and its time of day from a device's time column."""
    stamp = F.try_to_timestamp(F.col(f"`{column}`"), F.lit(TIME_FORMATS[kind]))
    return df.withColumn("timestamp", stamp).withColumn("time_of_day", F.date_format("timestamp", "HH:mm:ss.SSSSSS"))


def landmark_columns(columns: list[str], indices: list[int]) -> dict[str, str]:
    """Canonical names x<i>, y<i>, c<i> of landmark columns, whatever their case and confidence prefix. Missing ones raise."""
    lower = {c.lower(): c for c in columns}
    prefix = next((p for p in ("prob", "confidence", "c") if f"{p}{indices[0]}" in lower), None)
    wanted = {f"{a}{i}": f"{b}{i}" for i in indices for a, b in (("x", "x"), ("y", "y"), ("c", prefix)) if b}
    absent = [v for v in wanted.values() if v not in lower]
    if absent:
        raise ValueError("missing landmark columns: " + ", ".join(absent))
    return {k: lower[v] for k, v in wanted.items()}
