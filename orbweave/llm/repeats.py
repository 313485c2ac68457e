"""Removal of repeated word windows, counted exactly by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the first of its ``gram``-word pieces of least
hash, so equal windows have equal minimisers at equal places. Consecutive windows that share one travel as one packed
string (about 50 words for 15 windows) to the minimiser's bucket, where the strings of a bucket are cut into windows again
and sorted as text: a window that occurs twice, in any documents, stands beside its copy. Windows of one string differ, as
their minimiser stands at another place in each, so a minimiser met once needs no string at all: first slim rows (the
minimisers' hashes) are counted, and only documents with a minimiser that occurs again send strings.

Copies of whole documents are told by a digest of their words (128 bits), pre-aggregated: all windows of such a document
are repeated, and one of the copies stands for it towards the others.

Skew: a minimiser of more than ``LARGE`` strings (copies of one text, a line on every page) isn't gathered. Its strings
are first made distinct by digest, in each batch of documents and again before the shuffle; what is found out about a
string goes back to a batch as one row, whatever the number of its documents that hold it. If even the distinct strings
are more than ``LARGE``, each of their windows goes alone, by digest, to a pre-aggregated count. So a bucket holds at most
``LARGE`` strings in one task, of whatever table.

Lineage: the split words and the documents that send strings are written once each to the shared folder, which also keeps
the numbers of rows the same for all later reads.

Edge cases: a null or empty text has no words; a text of fewer words than a window loses none; repeated rows repeat each
other's windows; a null doc_id keeps its row; very long texts are cut into blocks of windows in the task; empty tables
give an empty result; further columns stay out, those named in ``keep`` are carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.storage import materialise

WINDOW = 35
GRAM = 8
LARGE = 500  # strings of one minimiser that a task holds at most
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("hits", pa.list_(pa.int32()))]))
BLOCK = 65_536  # windows whose minimisers are looked for at once
MEMO = 500_000  # hashes of words that a worker remembers

STRINGS = "uid long, start int, mini long, sid binary, n long, packed binary"
OFTEN = "batch long, mini long, sid binary, n long, packed binary, uids array<long>, starts array<int>"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def minimiser_runs(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each run that shares a minimiser (by place), and the minimisers' hashes, from hashes of words."""
    n = len(hashes) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = np.zeros(len(hashes) - gram + 1, np.uint64)
    for j in range(gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(g)]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    span = window - gram + 1
    at = np.concatenate([np.arange(i, min(i + BLOCK, n)) + sliding_window_view(g[i : min(i + BLOCK, n) + span - 1], span).argmin(axis=1) for i in range(0, n, BLOCK)])
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return starts, g[at[starts]]


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)))


def split(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Written: uid, ``keep``, doc (a digest of the words; null if there is no window), n_words, words (compressed), and per
    run of windows its first and its minimiser."""
    source = docs.select(F.monotonically_increasing_id().alias("uid"), *[F.col(c).alias(f"k_{c}") for c in keep], F.col("text").alias("t"))
    more = [T.StructField("doc", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("minis", T.ArrayType(T.LongType()))]
    schema = T.StructType([*source.schema.fields[:-1], *more])

    def run(batches):
        known, pack = _Hashes(), zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            counts, digests, blobs, starts, minis = [], [], [], [], []
            for text in b.column(b.num_columns - 1):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # at the six ASCII white spaces
                first, least = minimiser_runs(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), window, gram)
                line = b" ".join(words)
                counts.append(len(words))
                digests.append(xxhash.xxh3_128_digest(line) if len(first) else None)
                blobs.append(pack(line))
                starts.append(first)
                minis.append(least.view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary()), _lists(starts, np.int32), _lists(minis, np.int64)], schema.names)

    return materialise(source.mapInArrow(run, schema), "split-words")


def _distinct_documents(parts: DataFrame) -> DataFrame:
    """Written: of the documents of equal words one uid, their number n, and their minimisers."""
    return materialise(parts.where("doc is not null").groupBy("doc").agg(F.min("uid").alias("uid"), F.count("*").alias("n"), F.first("minis").alias("minis")), "distinct-documents")


def _senders(parts: DataFrame, distinct: DataFrame, large: int) -> tuple[DataFrame, bool]:
    """Written: the documents with a minimiser that occurs again, ``picks`` (the runs in question) and ``often`` (of each, if
    its minimiser has more than ``large`` strings); and whether there is any such."""
    minis = distinct.select("uid", F.posexplode("minis").alias("run", "mini"))
    again = materialise(minis.groupBy("mini").agg(F.count("*").alias("c")).where("c > 1").select("mini", (F.col("c") > large).alias("often")), "repeated-minimisers")
    picks = minis.join(again, "mini").groupBy("uid").agg(F.collect_list(F.struct("run", "often")).alias("picks"))
    some = parts.select("uid", "n_words", "words", "starts", "minis").join(picks, "uid")
    return materialise(some, "senders"), not again.where("often").isEmpty()


def _picked(batch, window: int):
    """uid, first window, minimiser and packed words of the picked runs of a batch of senders."""
    unpack = zstandard.ZstdDecompressor().decompress
    for uid, n, blob, starts, minis, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if not runs:
            continue
        line = unpack(blob)
        ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        begins, ends = np.r_[0, ends + 1], np.r_[ends, len(line)]
        stops = [*starts[1:], n - window + 1]
        for k in runs:
            yield uid, starts[k], minis[k], line[begins[starts[k]] : ends[stops[k] + window - 2]]


def _runs_of(senders: DataFrame, often: bool) -> DataFrame:
    return senders.select("uid", "n_words", "words", "starts", "minis", F.filter("picks", lambda p: p["often"] == F.lit(often))["run"].alias("runs"))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "spans": SPANS}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _strings(senders: DataFrame, window: int) -> DataFrame:
    """A row per picked run of a minimiser with few strings."""

    def run(batches):
        for b in batches:
            yield _batch([(uid, start, mini, None, 1, words) for uid, start, mini, words in _picked(b, window)], STRINGS)

    return _runs_of(senders, False).mapInArrow(run, STRINGS)


def _strings_of_batches(senders: DataFrame, window: int) -> DataFrame:
    """A row per distinct string of a minimiser with many and batch of documents (named by a uid of its own), with the places
    that hold it."""

    def run(batches):
        for b in batches:
            held: dict[bytes, tuple[int, bytes, list, list]] = {}
            for uid, start, mini, words in _picked(b, window):
                _, _, uids, starts = held.setdefault(xxhash.xxh3_128_digest(words), (mini, words, [], []))
                uids.append(uid)
                starts.append(start)
            yield _batch([(b.column(0)[0].as_py(), mini, sid, len(uids), words, uids, starts) for sid, (mini, words, uids, starts) in held.items()], OFTEN)

    return _runs_of(senders, True).mapInArrow(run, OFTEN)


def _back_to_documents(found: DataFrame) -> DataFrame:
    """uid and spans from batch, hits, uids and starts: the rows of a batch meet in one task, documents are told apart there."""

    def run(batches):
        of, spans = None, {}
        for b in batches:
            rows = []
            for batch, hits, uids, starts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if batch != of:
                    rows += spans.items()
                    of, spans = batch, {}
                for uid, start in zip(uids, starts, strict=True):
                    spans.setdefault(uid, []).append({"start": start, "hits": hits})
            yield _batch(rows, "uid long, spans spans")
        yield _batch(list(spans.items()), "uid long, spans spans")

    dealt = found.select("batch", "hits", "uids", "starts").repartition("batch").sortWithinPartitions("batch")
    return dealt.mapInArrow(run, "uid long, spans array<struct<start:int,hits:array<int>>>")


def _cut(line: bytes, window: int) -> list[bytes]:
    """The windows of a packed string."""
    ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    begins, ends = np.r_[0, ends + 1].tolist(), np.r_[ends, len(line)].tolist()
    return [line[begins[j] : ends[j + window - 1]] for j in range(len(begins) - window + 1)]


def repeated_in_bucket(strings: dict[bytes, int], window: int = WINDOW) -> dict[bytes, list[int]]:
    """Of distinct strings of one minimiser (and how often each occurs) the windows that occur again: by sorting them as text."""
    found: dict[bytes, list[int]] = {}
    if len(strings) == 1:
        ((line, n),) = strings.items()
        return {line: list(range(line.count(b" ") + 2 - window))} if n > 1 else {}
    windows = sorted((w, line, j) for line in strings for j, w in enumerate(_cut(line, window)))
    at = 0
    while at < len(windows):
        stop = at + 1
        while stop < len(windows) and windows[stop][0] == windows[at][0]:
            stop += 1
        if stop > at + 1 or strings[windows[at][1]] > 1:
            for _, line, j in windows[at:stop]:
                found.setdefault(line, []).append(j)
        at = stop
    return found


def _counted(strings: DataFrame, window: int) -> DataFrame:
    """uid, start, sid and ``hits`` (the windows that occur again) of strings, all those of a minimiser in one bucket."""
    dealt = strings.select("mini", "uid", "start", "sid", "n", "packed").repartition("mini").sortWithinPartitions("mini")  # a minimiser's strings arrive together

    def run(batches):
        held: list[tuple] = []

        def done():
            times: dict[bytes, int] = {}
            for r in held:
                times[r[5]] = times.get(r[5], 0) + r[4]
            hits = repeated_in_bucket(times, window)
            kept = [(r[1], r[2], r[3], hits[r[5]]) for r in held if r[5] in hits]
            return list(zip(*kept, strict=True)) if kept else None

        def batch(parts):
            columns = [sum((list(p[c]) for p in parts), []) for c in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.list_(pa.int32()))], ["uid", "start", "sid", "hits"])

        for b in batches:
            parts = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[0] != held[0][0]:
                    parts.append(done())
                    held.clear()
                held.append(row)
            yield batch([p for p in parts if p])
        if held and (last := done()):
            yield batch([last])

    return dealt.mapInArrow(run, "uid long, start int, sid binary, hits array<int>")


def _alone(distinct: DataFrame, window: int) -> DataFrame:
    """sid and ``hits`` of distinct strings, each window counted alone, by digest."""

    def run(batches):
        for b in batches:
            rows = [(sid, j, n, xxhash.xxh3_128_digest(w)) for sid, n, line in zip(*(c.to_pylist() for c in b.columns), strict=True) for j, w in enumerate(_cut(line, window))]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["sid", "j", "n", "w"])

    windows = distinct.select("sid", "n", "packed").mapInArrow(run, "sid binary, j int, n long, w binary")
    again = windows.groupBy("w").agg(F.sum("n").alias("c")).where("c > 1").select("w")
    return windows.join(again, "w").groupBy("sid").agg(F.collect_list("j").alias("hits"))


def repeated_windows(parts: DataFrame, window: int = WINDOW, large: int = LARGE) -> DataFrame:
    """uid, ``whole`` (a copy of a whole document: all its windows are repeated) and otherwise ``spans``: for each run with
    repeats its first window and which of its windows occur again."""
    distinct = _distinct_documents(parts)
    senders, any_often = _senders(parts, distinct, large)
    spans = _counted(_strings(senders, window), window).groupBy("uid").agg(F.collect_list(F.struct("start", "hits")).alias("spans"))
    if any_often:
        of_batches = _strings_of_batches(senders, window)
        strings = of_batches.groupBy("sid").agg(F.first("mini").alias("mini"), F.first("packed").alias("packed"), F.sum("n").alias("n"))
        strings = materialise(strings, "distinct-strings")
        sized = strings.join(strings.groupBy("mini").agg(F.count("*").alias("c")), "mini")
        few = sized.where(F.col("c") <= large).select("mini", F.lit(None).cast("long").alias("uid"), F.lit(None).cast("int").alias("start"), "sid", "n", "packed")
        of_strings = _counted(few, window).select("sid", "hits").unionByName(_alone(sized.where(F.col("c") > large), window))
        spans = spans.unionByName(_back_to_documents(of_batches.drop("packed").join(of_strings, "sid")))
        spans = spans.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    copies = parts.select("uid", "doc").join(distinct.where("n > 1").select("doc"), "doc").select("uid", F.lit(True).alias("whole"))
    return copies.join(spans, "uid", "full").select("uid", F.coalesce("whole", F.lit(False)).alias("whole"), F.when(F.col("whole").isNull(), F.col("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, gram: int = GRAM, large: int = LARGE) -> DataFrame:
    """``keep``, n_words, n_removed and ``kept``: the words that no repeated window covers, joined by one space.

    ``docs`` has the columns ``keep`` and ``text``; windows are judged on the input, not on what is left.
    """
    parts = split(docs, keep, window, gram)
    source = parts.drop("starts", "minis", "doc").join(repeated_windows(parts, window, large), "uid", "left").select(*[f"k_{c}" for c in keep], "n_words", "words", "whole", "spans")
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in keep], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    k = len(keep)

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            removed, kept = [], []
            for n, blob, whole, spans in zip(*(b.column(k + i).to_pylist() for i in range(4)), strict=True):
                line, gone = (b"", n) if whole else (unpack(blob), 0)
                if spans:
                    edges = np.zeros(n + 1, np.int64)
                    for s in spans:
                        first = s["start"] + np.array(s["hits"])
                        np.add.at(edges, first, 1)
                        np.add.at(edges, first + window, -1)
                    covered = np.cumsum(edges[:-1]) > 0
                    gone = int(covered.sum())
                    line = b" ".join(w for w, c in zip(line.split(b" "), covered.tolist(), strict=True) if not c)
                removed.append(gone)
                kept.append(line.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*b.columns[: k + 1], pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema.names)

    return source.mapInArrow(run, schema)


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w FROM documents),
v AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
s AS (SELECT r, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS n FROM v),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM s WHERE n > 1),
k AS (SELECT r, count(*) AS gone, list(p) AS ps FROM c GROUP BY r),
t AS (SELECT r, p, w[p] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
f AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept FROM t ANTI JOIN c USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r) LEFT JOIN f USING (r)
"""
