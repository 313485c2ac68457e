"""Probe logs as tables: the file tree, its lines, and what path, file name, header and reply lines say."""

from __future__ import annotations

import contextlib
import fnmatch

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.storage import materialise

# fixed values: the layout of log lines and file names
HEADER = r"^PING\s+(\S+)\(([^)]+)\)\s+from\s+(\S+)\s+(\S+):"
REPLY = r"^\[([0-9.]+)\]\s+\d+\s+bytes\s+from\s+(\S+):\s+icmp_seq=(\d+)\s+ttl=(\d+)\s+time=([0-9.]+)\s+ms$"
WHITE = " \t\r\n\x0b\x0c"
FILE_NAME = r"^ping-(.+)-(\d+ms)-(\d+h)-(\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2})\.txt$"

BLOCK = 1 << 16  # bytes; no split is smaller
PATHS_AT_MOST = 10_000  # of a list of files to read
SPLITS_AT_MOST = 500_000  # whose places are broadcast, at about a hundred bytes each

PATH_PARTS = ("measurement_family", "path_state", "location", "session_date")
NAME_PARTS = ("target_hint", "probe_interval", "window_duration", "window_start")
HEADER_PARTS = ("header_target", "header_target_ip", "header_source_ip", "interface")


def plain_path(uri: str = "_metadata.file_path") -> Column:
    """The path of the file that a row is read from, without the escapes of a URI and with one form of local paths."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


@contextlib.contextmanager
def listed_in_few_tasks(spark: SparkSession):
    """Readers made inside the block list their folders in a few tasks a core: by default each folder of a wide tree has a
    task of its own, and the driver a task's report for each."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def file_listing(spark: SparkSession, root: str | list[str], glob: str = "*") -> DataFrame:
    """path and length of every file below ``root`` (or of a list of files); contents are pruned from the scan. A missing
    root has no files.

    Scans leave empty files out, so the names come from the reader's own index, which the driver holds anyway.
    """
    if isinstance(root, str):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.createDataFrame([], "path string, length long")
    with listed_in_few_tasks(spark):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    names = spark.sparkContext._jvm.org.apache.hadoop.util.StringUtils.join("\n", found._jdf.inputFiles())  # one call, where inputFiles() has one a file; a URI has no line end
    listed = spark.createDataFrame(pa.table({"uri": pa.array(names.split("\n") if names else [], pa.string())}))
    listed = listed.select(plain_path("uri").alias("path")).where(F.element_at(F.split("path", "/"), -1).rlike(f"^{fnmatch.translate(glob)}"))
    return listed.join(found.select(plain_path().alias("path"), "length"), "path", "left").select("path", F.coalesce("length", F.lit(0).cast("long")).alias("length"))


def target_files(spark: SparkSession, root: str, manifest: DataFrame | None = None, max_files: int | None = None, glob: str = "ping-*.txt", most: int = PATHS_AT_MOST) -> list[str] | None:
    """The files to read, as a list for the reader: a manifest's (by ``rank``, if it has that, else by path) or, without
    one, the first by path, ``max_files`` at most.

    None if all are wanted, or more than ``most``: then the caller reads all and joins the manifest.
    """
    if manifest is None and max_files is None:
        return None
    if manifest is None:
        wanted, order = file_listing(spark, root, glob).select("path"), "path"
    else:
        wanted, order = manifest.select((F.concat(F.lit(root.rstrip("/") + "/"), "relative_path")).alias("path"), *[c for c in manifest.columns if c == "rank"]), "rank" if "rank" in manifest.columns else "path"
    rows = wanted.orderBy(order).limit(min(most + 1, max_files) if max_files is not None else most + 1).collect()
    return None if len(rows) > most else [r.path for r in rows]


def read_log_lines(spark: SparkSession, root: str | list[str], glob: str = "ping-*.txt") -> DataFrame:
    """path, line_no and line of each log below ``root`` (or of a list of files, as a manifest gives).

    Files are read line by line, so large ones are split. ``line_no`` rises with a line's place in its file, without being
    its number: it is the block that the line's split begins in, and the line's place in the task that read it.
    """
    with listed_in_few_tasks(spark):
        lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    split = F.floor(F.col("_metadata.file_block_start") / BLOCK).cast("long")
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return lines.select(plain_path().alias("path"), F.shiftleft(split, 33).bitwiseOR(in_task).alias("line_no"), F.col("value").alias("line"))


def placed_replies(lines: DataFrame, key: str = "path") -> DataFrame:
    """``parse_replies`` of log lines, written once, with ``place`` (from 0, among the file's replies) and ``n`` (their number).

    No line is shuffled or sorted: a task numbers what it reads, replies are counted per file and split (the high bits of
    line_no), and prefix sums over a file's splits tell where each split begins. That table is broadcast while it is small.
    """
    kept = materialise(parse_replies(lines).withColumn("_at", F.monotonically_increasing_id()), "replies")
    of_split = F.shiftright("line_no", 33)
    counts = kept.groupBy(key, of_split.alias("_split")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    file = Window.partitionBy(key)
    before = F.coalesce(F.sum("_n").over(file.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = materialise(counts.select(key, "_split", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(file).alias("n")), "splits")
    small = F.broadcast(begins) if begins.limit(SPLITS_AT_MOST + 1).count() <= SPLITS_AT_MOST else begins
    return kept.withColumn("_split", of_split).join(small, [key, "_split"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_split", "_at", "_shift")


def path_parts(path: str | Column = "relative_path") -> list[Column]:
    """The first four parts of a relative path; "" where there is none."""
    parts = F.split(path, "/")
    return [F.coalesce(F.get(parts, i), F.lit("")).alias(n) for i, n in enumerate(PATH_PARTS)]


def file_name_parts(path: str | Column = "relative_path") -> list[Column]:
    """Target (greedy), interval, duration and start of a file's name; "" where the name has another form."""
    name = F.element_at(F.split(path, "/"), -1)
    return [F.regexp_extract(name, FILE_NAME, i + 1).alias(n) for i, n in enumerate(NAME_PARTS)]


def parse_replies(lines: DataFrame) -> DataFrame:
    """The reply lines of (any columns, line), trimmed, with epoch, icmp_seq, ttl, latency_ms and reply_ip; others go."""
    text = F.btrim("line", F.lit(WHITE))
    kept = lines.where(text.rlike(REPLY))
    field = lambda i: F.regexp_extract(text, REPLY, i)
    return kept.select(
        *[c for c in lines.columns if c != "line"],
        field(1).try_cast("double").alias("epoch"), field(3).try_cast("long").alias("icmp_seq"), field(4).try_cast("int").alias("ttl"),
        field(5).try_cast("double").alias("latency_ms"), field(2).alias("reply_ip"),
    )


def parse_headers(lines: DataFrame, key: str = "path", order: str = "line_no") -> DataFrame:
    """``key`` and the four header fields, from the first header line of each file; files without one are left out."""
    text = F.btrim("line", F.lit(WHITE))
    heads = lines.where(text.rlike(HEADER)).groupBy(key).agg(F.min_by(text, order).alias("head"))
    return heads.select(key, *[F.regexp_extract("head", HEADER, i + 1).alias(n) for i, n in enumerate(HEADER_PARTS)])


def session_metadata(files: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """``files`` (relative_path, ...) with the twelve further strings of a session; blanks where nothing is known."""
    named = files.select("*", *path_parts(), *file_name_parts())
    if headers is None:
        return named.select("*", *[F.lit("").alias(n) for n in HEADER_PARTS])
    joined = named.join(headers, "relative_path", "left")
    return joined.withColumns({n: F.coalesce(n, F.lit("")) for n in HEADER_PARTS})


def load_time_bins(bins: DataFrame) -> DataFrame:
    """Bins as read back from a file: times parsed, bad dates null, and the 0-based place in the session added."""
    parsed = bins.withColumn("bin_start_utc", F.try_to_timestamp("bin_start_utc")).withColumn("session_date", F.to_date(F.try_to_timestamp("session_date")))
    order = Window.partitionBy("relative_path").orderBy("bin_epoch")
    return parsed.withColumn("session_bin_index", (F.row_number().over(order) - 1).cast("long"))
