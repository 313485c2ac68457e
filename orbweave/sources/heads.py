"""The heads of files: what a bounded look at the start of each tells of its kind, columns and rows."""

from __future__ import annotations

import csv
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.sources.logs import HEADER, REPLY, WHITE, file_listing, listed_in_few_tasks, plain_path

# fixed values: notes, and the columns of a log
REPLY_COLUMNS = ["epoch", "icmp_seq", "ttl", "latency_ms", "reply_ip"]
FOUND, NOT_FOUND = "ping log parsed", "text file did not match ping log pattern"
SKIPPED, UNSUPPORTED = "text-like file; schema sampling skipped", "non-tabular or unsupported extension"
FAILED = "tabular sample failed: "
SEPARATORS = {".csv": ",", ".tsv": "\t"}
TEXT_LIKE = (".json", ".jsonl", ".log")

MAX_ROWS = 25
RECORD = 1 << 20  # characters of one quoted record that are looked at
DELIMITED = "*.{[cC][sS][vV],[tT][sS][vV]}"
READ = "*.{[cC][sS][vV],[tT][sS][vV],[tT][xX][tT]}"


class LogHead:
    """Counts reply lines, ``max_rows`` at most."""

    def __init__(self, max_rows: int):
        self.most, self.count = max_rows, 0

    @property
    def done(self) -> bool:
        return self.count >= self.most

    def feed(self, line: bytes) -> None:
        text = line.decode("utf-8", "replace").strip(WHITE)
        self.count += bool(not re.match(HEADER, text) and re.match(REPLY, text))

    def result(self) -> tuple[bool, list[str], int, str]:
        return (True, REPLY_COLUMNS, self.count, FOUND) if self.count else (False, [], 0, NOT_FOUND)


class DelimitedHead:
    """The names in the first record and the number of records behind it, ``max_rows`` at most. Quoted fields may hold
    separators and line ends; blank lines don't count; names that occur again get a number, empty ones their place."""

    def __init__(self, max_rows: int, separator: str):
        self.most, self.separator = max_rows, separator
        self.columns: list[str] | None = None
        self.rows, self.pending, self.error = 0, "", ""

    @property
    def done(self) -> bool:
        return bool(self.error) or self.columns is not None and self.rows >= self.most

    def feed(self, line: bytes) -> None:
        try:
            text = line.decode("utf-8")
        except UnicodeDecodeError as e:
            self.error = f"{e.reason} at byte {e.start} of a line"
            return
        if self.columns is None and not self.pending:
            text = text.removeprefix("﻿")
        record = f"{self.pending}\n{text}" if self.pending else text
        if not record.strip(WHITE):
            return
        if record.count('"') % 2:
            self.pending = record
            if len(record) > RECORD:
                self.error = "a quoted field does not end"
            return
        self.pending = ""
        fields = next(csv.reader([record] if "\n" not in record else record.splitlines(keepends=True), delimiter=self.separator))
        if self.columns is None:
            self.columns = self._names(fields)
        elif len(fields) > len(self.columns):
            self.error = f"row {self.rows + 1} has {len(fields)} fields, expected {len(self.columns)}"
        else:
            self.rows += 1

    @staticmethod
    def _names(fields: list[str]) -> list[str]:
        out: list[str] = []
        for i, name in enumerate(fields):
            name = name or f"Unnamed: {i}"
            own, k = name, 0
            while own in out:
                k += 1
                own = f"{name}.{k}"
            out.append(own)
        return out

    def result(self) -> tuple[bool, list[str], int, str]:
        error = self.error or ("a quoted field does not end" if self.pending else "" if self.columns else "no columns")
        return (False, [], 0, FAILED + error) if error else (True, self.columns, self.rows, "")


def suffix_of(path: str) -> str:
    return (re.search(r"[^/](\.[^./]+)$", path) or [None, ""])[1].lower()


def file_heads(spark: SparkSession, root: str, max_rows: int = MAX_ROWS, glob: str = READ) -> DataFrame:
    """path, sampled, columns, row_sample_count and notes of the logs and delimited files below ``root`` that have a line.

    Files are read as lines, so any store of Spark's will do. A file's first split tells it all: its task stops as soon as
    it knows, and the tasks of further whole splits stop at once (a split that doesn't end its file has a task of its own).
    """
    with listed_in_few_tasks(spark):
        lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_block_start", "file_block_length", "file_size")]
    source = lines.select(plain_path().alias("path"), *meta, F.col("value").cast("binary").alias("line"))

    def head(path: str):
        suffix = suffix_of(path)
        return DelimitedHead(max_rows, SEPARATORS[suffix]) if suffix in SEPARATORS else LogHead(max_rows)

    def batch(found):
        kinds = [pa.string(), pa.bool_(), pa.list_(pa.string()), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["path", "sampled", "columns", "row_sample_count", "notes"])

    def run(batches):
        path, now, found = None, None, []
        for b in batches:
            paths, starts, lengths, sizes = (b.column(i).to_pylist() for i in range(4))
            for i, of in enumerate(paths):
                if of != path:
                    if now:
                        found.append((path, *now.result()))
                    path, now = of, head(of) if starts[i] == 0 else None
                if now and not now.done:
                    now.feed(b.column(4)[i].as_py() or b"")
                alone = starts[i] + lengths[i] < sizes[i]
                if alone and (now is None or now.done):
                    if now:
                        found.append((path, *now.result()))
                    if found:
                        yield batch(found)
                    return
            if found:
                yield batch(found)
                found = []
        if now:
            found.append((path, *now.result()))
        if found:
            yield batch(found)

    return source.mapInArrow(run, "path string, sampled boolean, columns array<string>, row_sample_count int, notes string")


def file_summary(spark: SparkSession, root: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per file below ``root``: relative_path, suffix, size_bytes, and, for logs and delimited files, what their heads hold.

    A file that can't be read as its kind has a note instead of columns; other kinds aren't opened.
    """
    return _summary(root, file_listing(spark, root), file_heads(spark, root, max_rows))


def _summary(root: str, listed: DataFrame, found: DataFrame) -> DataFrame:
    inside = F.regexp_replace("path", rf"^.*?{re.escape(root.rstrip('/').split('/')[-1])}/", "")
    suffix = F.lower(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1))
    kind = F.when(suffix.isin(*SEPARATORS), FAILED + "no columns").when(suffix == ".txt", NOT_FOUND).when(suffix.isin(*TEXT_LIKE), SKIPPED).otherwise(UNSUPPORTED)
    joined = listed.join(found, "path", "left")
    return joined.select(
        inside.alias("relative_path"), F.when(suffix == "", "<no_ext>").otherwise(suffix).alias("suffix"), F.col("length").alias("size_bytes"), F.coalesce("sampled", F.lit(False)).alias("sampled"),
        F.coalesce("columns", F.array().cast("array<string>")).alias("columns"), F.coalesce("row_sample_count", F.lit(0)).cast("int").alias("row_sample_count"), F.coalesce("notes", kind).alias("notes"),
    )


def csv_schema_sample(spark: SparkSession, root: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """relative_path, columns and row_sample_count of the delimited files below ``root`` that can be read; no others are opened."""
    delimited = file_listing(spark, root).where(F.col("path").rlike(r"(?i)\.(csv|tsv)$"))
    return _summary(root, delimited, file_heads(spark, root, max_rows, DELIMITED)).where(F.col("suffix").isin(*SEPARATORS) & F.col("sampled")).select("relative_path", "columns", "row_sample_count")
