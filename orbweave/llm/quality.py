"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Every text becomes a sparse vector: word unigrams, word bigrams and n-grams of word shapes (case pattern, digits, kind
of punctuation, "same as the word before"), hashed into ``2 ** bits`` slots. A score is the sparse dot product of that
vector with the weights, through the logistic function.

Training is distributed. The features of the labelled sample are written once. A row's shard is a hash of its doc_id;
each shard runs FTRL-proximal over its rows, in the order of another hash, from the current state; the states are added
up slot by slot in the order of the shards and averaged, and ``rounds`` such rounds are made. So the weights depend on the
rows alone, not on files, partitions or the number of cores. The state has a fixed size (``2 ** bits`` slots), so what is
broadcast or brought to the driver does not grow with the data.

Edge cases: a null or empty text has no n-grams and scores the bias alone; a document without a label is scored but
never learnt from; repeated rows are scored each on their own; empty tables give an empty result; a label table without
usable rows leaves all weights at zero (score 0.5).
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.storage import materialise

TOKEN = re.compile(r"\w+|[^\w\s]+")
BLOCK = 200_000  # tokens of one text that are held at once
SCALE = 8.0
MEMO = 400_000  # words whose hash is remembered in a Python worker


@dataclass(frozen=True)
class QualityParams:
    """``train_rows`` bounds the labelled sample (the rows of least hash); the rest are model parameters."""

    bits: int = 18
    train_rows: int = 8_000
    shards: int = 6
    rounds: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    threshold: float = 0.7


def _shape(word: str) -> int:
    c = word[0]
    if c.isalpha():
        if word.islower():
            return 1
        if len(word) > 1 and word.isupper():
            return 2
        if word[1:].islower() or len(word) == 1:
            return 3
        return 4 if word.isalpha() else 5
    if c.isdigit():
        return 6 if word.isdigit() else 7
    if len(word) == 1:
        return 8 if c in ".," else 9 if c in ";:?!'\"()-" else 10
    return 11 if len(set(word)) == 1 else 12


class _Words(dict):
    """word -> crc32 << 4 | shape, of the words met lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = code = zlib.crc32(word.encode("utf-8", "surrogatepass")) << 4 | _shape(word)
        return code


_words = _Words()


def _slots(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The hashed n-grams of a run of words, one array per family of n-grams."""
    mask, mix = np.uint64(2**bits - 1), np.uint64(0x9E3779B97F4A7C15)
    word, shape = codes >> np.uint64(4), (codes & np.uint64(15)).astype(np.uint64)
    shape[1:] |= (codes[1:] == codes[:-1]).astype(np.uint64) << np.uint64(4)
    fold = lambda x: np.maximum(((x * mix) >> np.uint64(20)) & mask, np.uint64(1))  # noqa: E731  slot 0 is the bias
    return [
        fold(word + np.uint64(1 << 40)),
        fold((word[:-1] * np.uint64(0x100000001B3)) ^ word[1:]),
        fold(np.concatenate([(shape[:-1] << np.uint64(5) | shape[1:]) + np.uint64(3 << 50), (shape[:-2] << np.uint64(10) | shape[1:-1] << np.uint64(5) | shape[2:]) + np.uint64(5 << 50)])),
    ]


def _blocks(text: str | None, bits: int):
    """The hashed n-grams of a whole text, family by family, in blocks of at most ``BLOCK`` words."""
    text, last = text or "", None
    tokens = iter(TOKEN.findall(text)) if len(text) < 8 * BLOCK else (m.group() for m in TOKEN.finditer(text))
    while block := list(islice(tokens, BLOCK)):
        codes = np.fromiter(map(_words.__getitem__, block), np.uint64, len(block))
        if last is not None:
            codes = np.concatenate([last, codes])  # n-grams over the border of two blocks
        yield _slots(codes, bits)
        last = codes[-1:]


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a whole text: SCALE times an n-gram's share of its family; slot 0 is the bias, of value 1."""
    counts = [{}, {}, {}]
    for block in _blocks(text, bits):
        for own, found in zip(counts, block, strict=True):
            for slot, n in zip(*(x.tolist() for x in np.unique(found, return_counts=True)), strict=True):
                own[slot] = own.get(slot, 0) + n
    values: dict[int, float] = {}
    for own in counts:
        total = sum(own.values())
        for slot, n in own.items():
            values[slot] = values.get(slot, 0.0) + SCALE * n / total
    values[0] = 1.0
    return np.fromiter(values.keys(), np.int64, len(values)), np.fromiter(values.values(), np.float64, len(values))


def dot(text: str | None, weights: np.ndarray, bits: int) -> float:
    """The sparse dot product of a whole text's features with the weights."""
    sums, totals = np.zeros(3), np.zeros(3)
    for block in _blocks(text, bits):
        for k, found in enumerate(block):
            sums[k] += weights[found].sum()
            totals[k] += len(found)
    return float(weights[0] + SCALE * (sums / np.maximum(totals, 1)).sum())


def _weights(z: np.ndarray, n: np.ndarray, p: QualityParams, bias: np.ndarray | bool) -> np.ndarray:
    l1 = np.where(bias, 0.0, p.l1)
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl_pass(rows, z: np.ndarray, n: np.ndarray, p: QualityParams) -> None:
    """One pass of FTRL-proximal over (slots, values, label) rows; z and n are updated in place."""
    for slots, values, label in rows:
        zs, ns = z[slots], n[slots]
        w = _weights(zs, ns, p, slots == 0)
        g = (_sigmoid(w @ values) - label) * values
        sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / p.alpha
        z[slots] = zs + g - sigma * w
        n[slots] = ns + g * g


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, label) for training: those of least hash among ``keep``.

    Of a doc_id with several label rows, one that is labelled in two ways is left out. The sample of ids is bounded by
    ``rows``, so it can be broadcast.
    """
    ids = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & keep)
    ids = ids.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top").drop("top")
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def training_rows(sample: DataFrame, p: QualityParams) -> DataFrame:
    """shard, place, tie (the order inside a shard), label, and the slots and values of each row's features, as bytes."""
    doc = F.col("doc_id").cast("string")
    keyed = sample.select(F.pmod(F.xxhash64(doc, F.lit(1)), F.lit(p.shards)).cast("int").alias("shard"), F.xxhash64(doc).alias("place"), F.xxhash64("doc_id", "text").alias("tie"), "label", "text")

    def run(batches):
        for b in batches:
            found = [features(t, p.bits) for t in b.column("text").to_pylist()]
            packed = [pa.array([x[k].astype(t).tobytes() for x in found], pa.binary()) for k, t in ((0, "<i4"), (1, "<f8"))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *packed], ["shard", "place", "tie", "label", "slots", "values"])

    return keyed.mapInArrow(run, "shard int, place long, tie long, label int, slots binary, values binary")


def ordered_rows(table: pa.Table):
    """The (slots, values, label) rows of a shard in their order."""
    for r in table.sort_by([("place", "ascending"), ("tie", "ascending")]).select(["slots", "values", "label"]).to_batches(256):
        for slots, values, label in zip(*(c.to_pylist() for c in r.columns), strict=True):
            yield np.frombuffer(slots, "<i4").astype(np.int64), np.frombuffer(values, "<f8"), label


def fit(docs: DataFrame, labels: DataFrame, keep, p: QualityParams = QualityParams()) -> np.ndarray:
    """Weights learnt from the labelled rows for which ``keep`` (a condition on doc_id) holds."""
    spark = docs.sparkSession
    rows = materialise(training_rows(labelled_sample(docs, labels, "quality", keep, p.train_rows), p), "quality-features")
    size = 2**p.bits
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(p.rounds):
        state = spark.sparkContext.broadcast((z, n))

        def train(table):  # noqa: B023  (runs before the state changes)
            z, n = (a.copy() for a in state.value)
            ftrl_pass(ordered_rows(table), z, n, p)
            at = np.flatnonzero(n)
            shard = np.full(len(at) + 1, table.column("shard")[0].as_py(), np.int32)
            # slot -1 counts the shards
            return pa.table({"shard": shard, "slot": [-1, *at.tolist()], "z": np.append(1.0, z[at]), "n": np.append(0.0, n[at])})

        # a shard holds its part of the bounded sample; sums are taken in the order of the shards, so that they are the same on every run
        states = rows.groupBy("shard").applyInArrow(train, "shard int, slot long, z double, n double")
        listed = states.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("shard", "z", "n"))).alias("s"))
        added = lambda c: F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x[c]).alias(c)
        mixed = listed.select("slot", added("z"), added("n")).toArrow()
        slots, z_sum, n_sum = (mixed.column(c).to_numpy() for c in ("slot", "z", "n"))
        at, shards = slots[slots >= 0], max(1.0, z_sum[slots < 0].sum())
        z, n = np.zeros(size), np.zeros(size)
        z[at], n[at] = z_sum[slots >= 0] / shards, n_sum[slots >= 0] / shards
        state.destroy()
    return _weights(z, n, p, np.arange(size) == 0)


def score(docs: DataFrame, weights: np.ndarray, p: QualityParams = QualityParams()) -> DataFrame:
    """``docs`` (any columns, with ``text``) with ``score`` and ``predicted`` added or replaced, a row for each row."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))
    docs = docs.drop("score", "predicted")
    names = docs.columns
    at = names.index("text")

    def run(batches):
        w = shared.value
        for b in batches:
            scores = [float(_sigmoid(dot(t, w, p.bits))) for t in b.column(at).to_pylist()]
            flags = pa.array([int(s >= p.threshold) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), flags], [*names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def held_out(modulus: int, remainder: int):
    """crc32(doc_id as text) mod ``modulus`` = ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
