"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has 64 bits: each is the majority, over the XXH64 values (seed 42) of its 3-word shingles with
repeats, of that bit. Two fingerprints are linked if they differ in at most ``2 * RADIUS`` = 2 bits. Every *distinct*
fingerprint emits the 65 values of its ball of radius 1. Two fingerprints that differ in at most two bits share such a
value, and two that share one differ in at most two bits, so all members of a shared value are linked to each other:
sorting a value's members and linking each to the one before keeps every connection without emitting all pairs (at most
65 distinct fingerprints can share a value). The links are verified and deduplicated.

*Components* are found by random contraction: in every round each node of the remaining graph is merged into the node of
least hash among itself and its neighbours (a new hash each round), and links between merged nodes are all that is left.
A round removes a fixed share of the nodes whatever the graph's shape (of a chain about half), so long chains take a
logarithmic number of rounds, and every round removes at least one node of each component, so they end. Rounds go on
until no link is left; the merges are then followed back from the last round to the first. All tables of a round are in
the shared folder.

A fingerprint that many rows share is not shuffled: those held by more than ``HOT`` rows are few (at most rows / HOT),
so their components are broadcast; all others are joined by shuffle.

Edge cases: null and empty texts have fingerprint zero, and are linked like any other; texts of fewer than three words
have one shingle, the whole sequence; a null doc_id keeps its row, never is a component's id unless nothing else is;
repeated rows stay rows; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.storage import materialise

RADIUS = 1
SHINGLE = 3
BLOCK = 100_000
HOT = 1_000_000  # rows of one fingerprint that go through one task of a join at most


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a whole text; the words of very long ones are hashed in blocks."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() touches A-Z only, bytes.split() the six ASCII white spaces
    words = data.split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
        return _majority(_bits(hashes), 1)
    total, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + SHINGLE - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = [0, *ends[: -SHINGLE].tolist()]
        stops = (ends[SHINGLE - 1 :] - 1).tolist()
        total += _bits(np.array([digest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64))
    return _majority(total, n)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest bit first."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp`` (the fingerprint as a signed long), a row for each row."""
    source = docs.select(*keep, "text")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("fp", T.LongType())])
    names = [*keep, "fp"]

    def run(batches):
        for b in batches:
            found = np.fromiter(map(fingerprint, b.column(len(keep)).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found.view(np.int64))], names)

    return source.mapInArrow(run, schema)


def ball_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b), a > b, between distinct fingerprints ``fp``; connectivity equals that of all links within two bits."""
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    variants = distinct.select("fp", F.explode(ball).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = variants.select(F.col("fp").alias("a"), before.alias("b")).where("b is not null and a <> b")
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2 * RADIUS).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the same root for all nodes of a connected component, for all nodes that have a link."""
    edges = materialise(links.select("a", "b").where("a <> b"), "links")
    merges: list[DataFrame] = []
    while not edges.isEmpty():
        by_hash = lambda node, k=len(merges): F.struct(F.xxhash64(node, F.lit(k)).alias("hash"), F.col(node).alias("name"))
        ends = edges.union(edges.select("b", "a")).toDF("node", "other")
        least = ends.groupBy("node").agg(F.min(by_hash("other")).alias("m"))
        merged = materialise(least.select("node", F.least("m", by_hash("node"))["name"].alias("into")), "merges")
        merges.append(merged)
        end = lambda name, merged=merged: merged.toDF(name, f"{name}_into")
        left = edges.join(end("a"), "a").join(end("b"), "b").where("a_into <> b_into")
        edges = materialise(left.select(F.greatest("a_into", "b_into").alias("a"), F.least("a_into", "b_into").alias("b")).distinct(), "links")
    if not merges:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = merges.pop()
    for merged in reversed(merges):  # each about half as large again as the one before
        after = roots.toDF("into", "last")
        roots = merged.join(after, "into", "left").select("node", F.coalesce("last", "into").alias("into"))
    return roots.withColumnRenamed("into", "root")


def near_duplicate_classes(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), hot: int = HOT) -> DataFrame:
    """The columns ``keep`` (with ``doc_id``), ``fp``, and ``component_id``: the smallest doc_id of the document's component."""
    marked = materialise(fingerprints(docs, keep), "fingerprints")
    per_fp = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))  # pre-aggregated: a hot group is a row per task
    per_fp = materialise(per_fp, "distinct-fingerprints")
    roots = components(ball_links(per_fp.select("fp")))
    joined = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(joined.join(least, "root").select("fp", "component_id", "n"), "components")
    often = F.broadcast(named.where(F.col("n") > hot).select("fp", F.col("component_id").alias("own"), F.lit(True).alias("often")))  # at most rows / hot
    seen = marked.join(often, "fp", "left")
    usual = seen.where("often is null").drop("own", "often").join(named.where(F.col("n") <= hot).drop("n"), "fp")
    return usual.unionByName(seen.where("often").withColumnRenamed("own", "component_id").drop("often"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without all but the first document of each component (of repeated rows, one stays)."""
    names = docs.columns
    uid = "__row"
    numbered = materialise(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    classes = near_duplicate_classes(numbered, ("doc_id", uid))
    # documents with null ids come last in their component
    chosen = classes.groupBy(F.coalesce("component_id", F.lit(-1)), F.when(F.col("component_id").isNull(), F.col("fp"))).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", uid)).alias("first"))
    return numbered.join(chosen.select(F.col(f"first.{uid}").alias(uid)), uid, "left_semi").select(*names)
