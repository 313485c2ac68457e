"""Token ids as flat binary files: unsigned integers, 64-bit document offsets, memory-mapped on reading.

A data set is a folder of shards in the order of given columns (by default ascending doc_id). Shard k has three files, all little-endian:

* ``shard-k.bin``: the ids of its documents, one after another, each document followed by the end id; two bytes an id if
  the vocabulary and the end id fit, else four (the manifest tells);
* ``shard-k.idx``: signed 64-bit offsets in ids, one more than it has documents, from 0;
* ``shard-k.doc``: the documents' ids, signed 64-bit (the least value stands for null).

Shards are range partitions of the documents, so no task needs to know the ones before it; what each shard begins at in
the whole sequence is the prefix sum of the shards' token counts (one row per shard), kept in the folder ``manifest``.
A task writes under a name of its own attempt and renames at the end, so a retried or doubled task leaves whole files.

Edge cases: a null text is an empty one (the end id alone); a null doc_id sorts first; rows of the same place
are ordered by text; repeated rows are written each; an empty table makes a folder without shards and an empty result.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyarrow import fs

from orbweave.llm.encoding import WordEncoder
from orbweave.storage import open_folder

NO_ID = -(1 << 63)


class _ShardWriter:
    def __init__(self, folder: str, shard: int, attempt: int, width: int):
        self.width = width
        self.fs, root = open_folder(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = {kind: f"{root}/shard-{shard:06d}.{kind}" for kind in ("bin", "idx", "doc")}
        self.temp = {kind: f"{name}.{attempt}" for kind, name in self.final.items()}
        self.out = {kind: self.fs.open_output_stream(name) for kind, name in self.temp.items()}
        self.tokens, self.docs = 0, 0
        self.out["idx"].write(np.int64(0).tobytes())

    def add(self, doc_id: int | None, pieces) -> None:
        for piece in pieces:
            self.out["bin"].write(piece)
            self.tokens += len(piece) // self.width
        self.docs += 1
        self.out["idx"].write(np.int64(self.tokens).tobytes())
        self.out["doc"].write(np.int64(NO_ID if doc_id is None else doc_id).tobytes())

    def close(self) -> None:
        for kind, stream in self.out.items():
            stream.close()
            self.fs.move(self.temp[kind], self.final[kind])


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, shards: int | None = None, by: tuple[str, ...] = ("doc_id",)) -> list[tuple[int, int, int, int]]:
    """Write ``docs`` (doc_id, text) as a data set in the order of ``by``; (shard, documents, tokens, first token) of each shard, in order."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dtype = np.dtype("<u2" if WordEncoder.of(tokenizer_path).dtype == "<u2" and end_id < 1 << 16 else "<u4")

    def run(batches):
        encoder, task, out = WordEncoder.of(tokenizer_path), TaskContext.get(), None
        end = np.array([end_id], dtype).tobytes()
        sized = (lambda piece: piece) if encoder.dtype == dtype else lambda piece: np.frombuffer(piece, encoder.dtype).astype(dtype).tobytes()
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for i, pieces in encoder.encode(b.column("text").to_pylist()):
                out = out or _ShardWriter(folder, task.partitionId(), task.taskAttemptId(), dtype.itemsize)
                out.add(ids[i], chain(map(sized, pieces), [end]))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "n_docs": [out.docs], "n_tokens": [out.tokens]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c for c in by if c not in ("doc_id", "text"))).repartitionByRange(shards, *by).sortWithinPartitions(*by, "text")
    stats = sorted(tuple(r) for r in ordered.mapInArrow(run, "shard long, n_docs long, n_tokens long").collect())  # a row per shard
    bases = np.concatenate([[0], np.cumsum([n for _, _, n in stats])]).astype(int).tolist()
    shape = [(k, d, n, base) for (k, d, n), base in zip(stats, bases, strict=False)]
    spark.createDataFrame([(*s, dtype.str) for s in shape], "shard long, n_docs long, n_tokens long, base long, dtype string").coalesce(1).write.json(f"{folder.rstrip('/')}/manifest")
    return shape


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as 32-bit integers) of every document of a data set, read from its mapped files."""
    shape = [(r.shard, r.base, r.dtype) for r in spark.read.schema("shard long, base long, dtype string").json(f"{folder.rstrip('/')}/manifest").orderBy("shard").collect()]
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shape:
        return spark.createDataFrame([], out)

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                shard, base, dtype = shape[k]
                ids, offsets, docs = (mapped(folder, shard, kind, t) for kind, t in (("bin", dtype), ("idx", "<i8"), ("doc", "<i8")))
                for at in range(0, len(docs), 4096):
                    stop = min(len(docs), at + 4096)
                    o = np.asarray(offsets[at : stop + 1])
                    crcs = [zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                    names = np.asarray(docs[at:stop])
                    yield pa.RecordBatch.from_arrays([pa.array(names, mask=names == NO_ID), pa.array(o[:-1] + base), pa.array(np.diff(o)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(shape), 1, len(shape)).mapInArrow(run, out)


def mapped(folder: str, shard: int, kind: str, dtype: str) -> np.ndarray:
    """A shard's file as an array: a memory map where the store is a mounted folder, else a download of that file."""
    store, root = open_folder(folder)
    name = f"{root}/shard-{shard:06d}.{kind}"
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(name, dtype, "r")
    return np.frombuffer(store.open_input_file(name).readall(), dtype)
