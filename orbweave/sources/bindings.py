"""Probe sessions, log lines and file inventories made from the tables of a data folder."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.storage import open_folder, read_table

DAY = 86_400
META = ("relative_path", "measurement_family", "path_state", "location", "session_date", "target_hint", "probe_interval", "window_duration", "window_start")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per event: the user is the session, the value the latency."""
    events = read_table(spark, sf_dir, "events")
    u = F.col("user_id")
    state = F.when(u % 5 == 0, "inactive").otherwise("active")
    duration = F.when(u % 3 == 0, "2h").otherwise("1h")
    target = F.when(u % 11 != 0, F.concat(F.lit("tgt"), (u % 7).cast("string")))
    date = F.concat(F.lit("2024-01-"), F.lpad((1 + u % 28).cast("string"), 2, "0"))
    start = F.concat(date, F.lit("-00-00-00"))
    path = F.concat_ws("/", F.lit("inside-out"), state, F.concat(F.lit("loc"), (u % 12).cast("string")), date, F.concat(F.lit("ping-"), F.coalesce(target, F.lit("")), F.lit("-10ms-"), duration, F.lit("-"), start, F.lit("-u"), F.lpad(u.cast("string"), 6, "0"), F.lit(".txt")))
    k = F.get_json_object("props", "$.k").cast("int")
    return events.where(u.isNotNull() & F.col("ts").isNotNull()).select(
        "event_id", path.alias("relative_path"), F.lit("inside-out").alias("measurement_family"), state.alias("path_state"), F.concat(F.lit("loc"), (u % 12).cast("string")).alias("location"),
        date.alias("session_date"), target.alias("target_hint"), F.lit("10ms").alias("probe_interval"), duration.alias("window_duration"), start.alias("window_start"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("epoch"), (F.col("event_id") % 65536).cast("long").alias("icmp_seq"), (40 + k % 24).cast("int").alias("ttl"), F.col("value").cast("double").alias("latency_ms"),
    )


def _reply_line(number: Column) -> Column:
    return F.concat(F.lit("  ["), F.format_string("%.6f", "epoch"), F.lit("] 64 bytes from 2605:59c8::"), (F.col("event_id") % 97).cast("string"), F.lit(": icmp_seq="), number.cast("string"), F.lit(" ttl="), F.col("ttl").cast("string"), F.lit(" time="), F.format_string("%.3f", "latency_ms"), F.lit(" ms "))


def _logged(o: DataFrame, number: Column) -> DataFrame:
    replies = o.select(F.col("relative_path").alias("path"), (F.col("event_id") + 2).alias("line_no"), _reply_line(number).alias("line"))
    heads = o.groupBy("relative_path").agg(F.min("location").alias("l"), F.min("target_hint").alias("t")).where("t is not null")
    head = lambda ip, no: heads.select(F.col("relative_path").alias("path"), F.lit(no).cast("long").alias("line_no"), F.concat(F.lit("PING "), "t", F.lit(f"({ip}) from 192.168.1.7 "), "l", F.lit(": 56 data bytes")).alias("line"))
    return replies.union(head("100.64.0.1", 0)).union(head("100.64.0.2", 1))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line_no, line: each event as a reply line, and each document as one that is not."""
    noise = read_table(spark, sf_dir, "documents").select(F.concat(F.lit("inside-out/noise/"), F.col("source"), F.lit("/x/note-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("doc_id").alias("line_no"), F.col("text").alias("line"))
    return _logged(observations(spark, sf_dir), F.col("icmp_seq")).union(noise)


LAYOUT = ("family", "state", "location", "date", "name")  # of written logs: a label before each part of a relative path
LOGS = "name=*"  # their file names


class _LogWriter:
    """One log at a time, written under a hidden name of the task's attempt and renamed when it is whole."""

    def __init__(self, root: str, attempt: int):
        (self.fs, self.root), self.attempt = open_folder(root), attempt
        self.folders: set[str] = set()
        self.name = self.out = None

    def add(self, name: str, lines: list[str | None]) -> None:
        if name != self.name:
            self.close()
            folder, _, file = f"{self.root}/{name}".rpartition("/")
            if folder not in self.folders:
                self.fs.create_dir(folder, recursive=True)
                self.folders.add(folder)
            self.name, self.temp = name, f"{folder}/.{self.attempt}-{file}"
            self.out = self.fs.open_output_stream(self.temp)
        self.out.write("".join([f"{x or ''}\n" for x in lines]).encode())

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
        self.name = self.out = None


def write_logs(spark: SparkSession, sf_dir: str, root: str) -> str:
    """The events as a tree of logs below ``root``, one file per session; icmp_seq is the event_id.

    Sessions are many and small, so tasks write the files themselves: Spark's writer makes a folder per file, and each
    folder and file costs it several calls, up to a process each on a plain disk, and a rename by the driver.
    """
    lines = _logged(observations(spark, sf_dir), F.col("event_id")).select(stored("path").alias("name"), "line_no", "line")

    def run(batches):
        out, count = _LogWriter(root, TaskContext.get().taskAttemptId()), 0
        for b in batches:
            runs, at = pc.run_end_encode(b.column(0)), 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                out.add(name, b.column(1).slice(at, end - at).to_pylist())
                at = end
            count += b.num_rows
        out.close()
        yield pa.RecordBatch.from_pydict({"lines": [count]})

    lines.repartition("name").sortWithinPartitions("name", "line_no").select("name", "line").mapInArrow(run, "lines long").agg(F.sum("lines")).collect()
    return root


def inside(path: str = "path") -> Column:
    """The relative path that a written log stands for."""
    return F.regexp_replace(F.regexp_extract(path, "(family=.*)$", 1), rf"\b({'|'.join(LAYOUT)})=", "")


def stored(relative_path: str = "relative_path") -> Column:
    """Where below the root the log of a relative path is written."""
    parts = F.split(relative_path, "/")
    return F.concat_ws("/", *[F.concat(F.lit(f"{c}="), parts[i]) for i, c in enumerate(LAYOUT)])


def write_tree(spark: SparkSession, sf_dir: str, root: str) -> str:
    """A tree of mixed files: logs, delimited files with awkward names and texts, notes, and files that aren't opened."""
    write_logs(spark, sf_dir, f"{root}/logs")
    orders, customers = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    rows = orders.select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("key, time"), F.col("o_totalprice").cast("decimal(18,2)").alias('the "delay"'), F.concat(F.lit("first,\nsecond "), F.col("o_orderkey").cast("string")).alias("two\nlines"))
    rows.repartition("name").write.partitionBy("name").csv(f"{root}/orders", header=True, quoteAll=True, escape='"')
    rows = customers.select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("node"), F.col("c_name").alias("a, b"))
    rows.repartition("name").write.partitionBy("name").option("extension", "tsv").csv(f"{root}/customers", header=True, sep="\t")
    notes = read_table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("name"), F.col("text").alias("line"))
    notes.repartition("name").write.partitionBy("name").text(f"{root}/notes")
    read_table(spark, sf_dir, "nation").coalesce(1).write.json(f"{root}/nations")
    read_table(spark, sf_dir, "region").coalesce(1).write.parquet(f"{root}/regions")
    return root


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file inventory made from documents: relative_path, suffix, size_bytes, sampled, columns, row_sample_count, notes."""
    i = F.col("doc_id")
    state = F.when(i % 5 == 0, "inactive").otherwise("active")
    date = F.concat(F.lit("2024-01-"), F.lpad((1 + i % 28).cast("string"), 2, "0"))
    name = F.when(i % 13 == 0, F.concat(F.lit("table-"), i.cast("string"), F.lit(".csv"))).otherwise(F.concat(F.lit("ping-"), F.col("lang"), F.lit("-10ms-"), F.when(i % 3 == 0, "2h").otherwise("1h"), F.lit("-"), date, F.lit("-00-00-00.txt")))
    path = F.concat_ws("/", F.lit("inside-out"), state, F.col("source"), date, F.concat(F.when(i % 17 == 0, ".").otherwise(""), F.col("doc_id").cast("string"), F.lit("/"), name))
    csv = i % 13 == 0
    hits = F.when(csv, F.lit(25)).otherwise((i % 40).cast("int"))
    columns = F.when(csv, F.array(F.lit("Timestamp"), F.lit("delay_ms"))).otherwise(F.when(hits > 0, F.array(*map(F.lit, ("epoch", "icmp_seq", "ttl", "latency_ms", "reply_ip")))).otherwise(F.array().cast("array<string>")))
    return read_table(spark, sf_dir, "documents").select(
        path.alias("relative_path"), F.when(csv, ".csv").otherwise(".txt").alias("suffix"), (F.col("n_chars") * 65536).cast("long").alias("size_bytes"), (csv | (hits > 0)).alias("sampled"), columns.alias("columns"),
        F.least(hits, F.lit(25)).cast("int").alias("row_sample_count"), F.when(csv, "").when(hits > 0, "ping log parsed").otherwise("text file did not match ping log pattern").alias("notes"),
    )
