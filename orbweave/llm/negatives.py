"""Hard negatives from Hilbert-ordered blocks with zone maps.

Vectors become whole numbers, ``floor(scale * x)`` of each component, and scores are their inner products, computed
exactly. Candidates are ordered by label and by their place on a Hilbert curve through the ``AXES`` components of largest
variance, cut into blocks of ``BLOCK`` rows of one label, and written as Parquet: a row holds a block, with the least and
largest value of every component (its zone map) beside the packed vectors. The scan of the zone maps reads no vectors.

An anchor's inner product with anything in a block lies between the sums of the smaller and of the larger products with
the ends of the block's intervals. These bounds choose the blocks that an anchor must read:

* positives (the first ``positives`` other rows of its label): first the ``PROBES`` blocks of its label with the highest
  upper bound; then all others of its label whose upper bound reaches the last score kept from the first;
* negatives: for each positive, the blocks of other labels whose bounds meet its window of scores, from ``low``/100 of the
  positive's score to all of it; the first ``negatives`` rows of the window are kept.

Anchors are handled in groups of ``GROUP`` bytes of vectors, which bounds what is broadcast whatever the table's size. A
group's job joins the blocks in need to their anchors and keeps the best rows per task; what is shuffled beside the blocks
is at most a list of the best rows per task, anchor and positive. An anchor reads only whole blocks, so equal vectors or a
label that holds most rows are many blocks like any others.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part; vectors of different
lengths aren't compared; ``vec_id`` ties (repeated rows) are rows of their own, told apart by a row number, and a null
vec_id comes last and is no anchor; fewer rows than wanted give what there is; scores beyond 64 bits are held at the ends
of that range; empty tables give an empty result; further columns stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.storage import materialise

BLOCK = 512
AXES, BITS = 15, 4  # of the Hilbert curve: 60 bits of key
PROBES = 2
GROUP = 16 << 20  # bytes of anchors' vectors that are broadcast at once
POSITIVES, NEGATIVES, LOW = 5, 5, 80
EXACT = 1 << 53
ENDS = (-(1 << 63), (1 << 63) - 1)

ZONES = "uids binary, ids binary, vectors binary, rows int, dims int, least array<double>, most array<double>"


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of cell numbers (below 2 to the ``bits``), as one whole number.

    The axes' bits are undone plane by plane from the highest: where a plane's bit is set, the lower bits of the first axis
    are inverted, else exchanged with that axis's; a Gray code over the axes follows.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    if not n:
        return np.zeros(len(cells), np.int64)
    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for axis in range(n):
            is_set = (x[axis] >> plane & 1).astype(bool)
            swapped = (x[0] ^ x[axis]) & low
            x[0] = np.where(is_set, x[0] ^ low, x[0] ^ swapped)
            if axis:
                x[axis] = np.where(is_set, x[axis], x[axis] ^ swapped)
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> plane & 1, (1 << plane) - 1, 0)
    x ^= flip
    keys = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, -1, -1):
        for axis in range(n):
            keys = keys << 1 | (x[axis] >> plane & 1)
    return keys


def prepared(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """uid, vec_id, label and q (whole numbers, as doubles) of the rows that take part; every seventh id has the next label."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * F.lit(float(scale)))
    x = F.transform(scaled, lambda v: F.when(F.abs(v) < float(EXACT), F.floor(v).cast("double")).otherwise(v))  # larger doubles are whole
    whole = F.forall(scaled, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))  # NaN counts as larger
    shifted = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    kept = vectors.where(F.col("label").isNotNull() & F.coalesce(whole, F.lit(False)))
    return kept.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), shifted.cast("long").alias("label"), x.alias("q"))


def _cells(q: np.ndarray, centre: np.ndarray, spread: np.ndarray, bits: int) -> np.ndarray:
    """Cells between two deviations below and above the mean."""
    return np.clip(((q - centre) / np.maximum(spread, 1e-300) + 2) * (1 << bits) / 4, 0, (1 << bits) - 1).astype(np.int64)


def _axes(rows: DataFrame) -> dict[int, tuple[list[int], np.ndarray, np.ndarray]]:
    """Per vector length: the components of largest variance, with mean and deviation. What reaches the driver is a row per
    length and component."""
    stats = rows.select(F.size("q").alias("d"), F.posexplode("q").alias("i", "v")).groupBy("d", "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    out = {}
    for d in {r.d for r in stats}:
        own = sorted((r for r in stats if r.d == d), key=lambda r: (-r.s, r.i))[:AXES]
        out[d] = [r.i for r in own], np.array([r.m for r in own]), np.array([r.s for r in own])
    return out


def build_blocks(rows: DataFrame, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """Written: block, label and the packed rows of ``prepared`` with their zone map, in the order of the curve."""
    axes = _axes(rows)

    def keyed(batches):
        for b in batches:
            keys = []
            for q in b.column("q").to_pylist():
                which, centre, spread = axes.get(len(q), ([], np.zeros(0), np.zeros(0)))
                keys.append(_cells(np.array([q[i] for i in which], float), centre, spread, bits))
            key = np.zeros(len(keys), np.int64)
            sizes = np.array(list(map(len, keys)))
            for d in set(sizes.tolist()):
                own = np.flatnonzero(sizes == d)
                key[own] = hilbert_keys(np.array([keys[i] for i in own]).reshape(len(own), d), bits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], [*b.schema.names, "key"])

    with_key = materialise(rows.mapInArrow(keyed, "uid long, vec_id long, label long, q array<double>, key long"), "keyed").withColumn("d", F.size("q"))
    order = ["label", "d", "key", "uid"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = with_key.repartitionByRange(n, *order).sortWithinPartitions(*order).select("uid", "vec_id", "label", "q")

    def packed(label, held):
        held.sort(key=lambda r: (r[1] is None, r[1], r[0]))  # ties of scores by smaller vec_id
        q = np.array([r[2] for r in held], np.float64).reshape(len(held), len(held[0][2]))
        ids = np.array([ENDS[1] if r[1] is None else r[1] for r in held], np.int64)
        return label, np.array([r[0] for r in held], np.int64).tobytes(), ids.tobytes(), q.tobytes(), len(q), q.shape[1], q.min(axis=0).tolist(), q.max(axis=0).tolist()

    def run(batches):
        held, of = [], None
        for b in batches:
            made = []
            for uid, vec_id, label, q in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and ((label, len(q)) != of or len(held) == block):
                    made.append(packed(of[0], held))
                    held = []
                of = label, len(q)
                held.append((uid, vec_id, q))
            yield from batch(made)
        if held:
            yield from batch([packed(of[0], held)])

    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    names = ["label", *[x.split()[0] for x in ZONES.split(", ")]]

    def batch(made):
        for at in range(0, len(made), 64):  # a block is about 256 KB
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made[at : at + 64], strict=True), kinds, strict=True)], names)

    return materialise(ranged.mapInArrow(run, f"label long, {ZONES}").withColumn("block", F.monotonically_increasing_id()), "blocks")


def bounds(anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per anchor: the least and the largest inner product that anything within the intervals can have."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.clip(up @ least + down @ most, -(2.0**63), 2.0**63), np.clip(up @ most + down @ least, -(2.0**63), 2.0**63)


def scores(x: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products (rows of ``x`` by anchors): in doubles where none can exceed 53 bits, else in Python's integers."""
    if not x.size or not anchors.size:
        return np.zeros((len(x), len(anchors)), np.int64)
    if float(np.abs(x).max()) * float(np.abs(anchors).max()) * x.shape[1] < EXACT:
        return (x @ anchors.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in x], object) @ np.array([[int(v) for v in r] for r in anchors], object).T
    return np.array([[min(max(v, ENDS[0]), ENDS[1]) for v in r] for r in exact], np.int64).reshape(len(x), len(anchors))


class _Best:
    """For each of a number of lists, the best ``k`` (score, vec_id, uid): higher scores first, ties by smaller vec_id, then uid."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.score = np.full((lists, k), ENDS[0], np.int64)
        self.ids = np.full((lists, k), ENDS[1], np.int64)
        self.uids = np.full((lists, k), -1, np.int64)

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        """Rows of up to ``k`` more for each of ``lists``; uid -1 is none."""
        s, i, u = (np.concatenate([a[lists], b], axis=1) for a, b in ((self.score, score), (self.ids, ids), (self.uids, uids)))
        order = np.lexsort((u, i, ~s, u < 0), axis=1)[:, : self.k]  # ~ reverses the order without overflow
        self.score[lists], self.ids[lists], self.uids[lists] = (np.take_along_axis(a, order, axis=1) for a in (s, i, u))

    def rows(self):
        at, k = np.nonzero(self.uids >= 0)
        return at, self.score[at, k], self.ids[at, k], self.uids[at, k]


def _kept(found: np.ndarray, x_ids: np.ndarray, x_uids: np.ndarray, allowed: np.ndarray, k: int):
    """The first ``k`` allowed rows of each column of scores, as arrays with a row per column."""
    n = len(found)
    if n > k and np.abs(found).max(initial=0) < EXACT // n:  # rows stand by vec_id, so score and place are one key without ties
        keys = np.where(allowed, found, -(EXACT // n)) * n - np.arange(n)[:, None]
        some = np.argpartition(-keys, k, axis=0)[:k]
        order = np.take_along_axis(some, np.argsort(-np.take_along_axis(keys, some, axis=0), axis=0), axis=0).T
    else:
        order = np.argsort(~np.where(allowed, found, ENDS[0]), axis=0, kind="stable")[:k].T
    ok = np.take_along_axis(allowed.T, order, axis=1)
    return np.take_along_axis(found.T, order, axis=1), x_ids[order], np.where(ok, x_uids[order], -1)


def _read(blocks: DataFrame, need: DataFrame, lists: int, k: int, each) -> DataFrame:
    """list, score, vec_id, uid: the best ``k`` rows of every list over all blocks that ``need`` (block, anchors) names.

    ``each(best, vectors, ids, uids, anchors)`` adds a block's rows to a task's best.
    """
    joined = blocks.select("block", "uids", "ids", "vectors", "rows", "dims").join(need, "block")

    def run(batches):
        best = _Best(lists, k)
        for b in batches:
            for _, uids, ids, vectors, n, d, anchors in zip(*(c.to_pylist() for c in b.columns), strict=True):
                each(best, np.frombuffer(vectors).reshape(n, d), np.frombuffer(ids, np.int64), np.frombuffer(uids, np.int64), np.frombuffer(anchors, np.int32))
        at, score, ids, uids = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(score), pa.array(ids), pa.array(uids)], ["list", "score", "vec_id", "uid"])

    found = joined.mapInArrow(run, "list int, score long, vec_id long, uid long")
    first = F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("o"), "vec_id", "uid", "score"))), 1, k)
    return found.groupBy("list").agg(first.alias("r")).select("list", F.posexplode("r").alias("place", "x")).select("list", "place", "x.score", "x.vec_id", "x.uid")


def _needed(blocks: DataFrame, choose) -> DataFrame:
    """block and anchors (packed numbers) for the blocks that ``choose(label, dims, least, most)`` names anchors of; reads
    zone maps only."""

    def run(batches):
        for b in batches:
            out = []
            for block, label, d, least, most in zip(*(c.to_pylist() for c in b.columns), strict=True):
                anchors = choose(block, label, d, np.array(least, float), np.array(most, float))
                if len(anchors):
                    out.append((block, anchors.astype(np.int32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], ["block", "anchors"])

    return blocks.select("block", "label", "dims", "least", "most").mapInArrow(run, "block long, anchors binary")


def _probed(blocks: DataFrame, group: dict, probes: int) -> dict[int, list[int]]:
    """Per anchor of the group, the blocks of its label with the highest upper bound."""
    vectors, labels, dims = group["q"], group["label"], group["d"]

    def run(batches):
        high, which = np.full((len(labels), probes), -np.inf), np.full((len(labels), probes), -1, np.int64)
        for b in batches:
            for block, label, d, least, most in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = np.flatnonzero((labels == label) & (dims == d))
                if len(own):
                    up = bounds(vectors[own, :d], np.array(least, float), np.array(most, float))[1]
                    h, w = np.c_[high[own], up], np.c_[which[own], np.full(len(own), block)]
                    order = np.argsort(-h, axis=1, kind="stable")[:, :probes]
                    high[own], which[own] = np.take_along_axis(h, order, 1), np.take_along_axis(w, order, 1)
        at, k = np.nonzero(which >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(which[at, k]), pa.array(high[at, k])], ["anchor", "block", "high"])

    rows = blocks.select("block", "label", "dims", "least", "most").mapInArrow(run, "anchor int, block long, high double")
    best = rows.groupBy("anchor").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("high")).alias("o"), "block"))), 1, probes)["block"].alias("b"))
    return {r.anchor: r.b for r in best.collect()}


def _group_rows(group: dict, blocks: DataFrame, positives: int, negatives: int, low: int, probes: int):
    """The result rows of one group of anchors."""
    vectors, labels, dims, own_uids = group["q"], group["label"], group["d"], group["uid"]
    first = _probed(blocks, group, probes)
    by_block: dict[int, list[int]] = {}
    for a, names in first.items():
        for name in names:
            by_block.setdefault(name, []).append(a)

    def positive(best, x, ids, uids, anchors):
        found = scores(x, vectors[anchors, : x.shape[1]])
        best.add(anchors, *_kept(found, ids, uids, uids[:, None] != own_uids[anchors][None, :], best.k))

    probe = _read(blocks, _needed(blocks, lambda block, *_: np.array(by_block.get(block, []), np.int32)), len(labels), positives, positive).collect()  # at most probes' best of a group
    reached = np.full(len(labels), -np.inf)
    for r in probe:
        if r.place == positives - 1:
            reached[r.list] = r.score

    def others(block, label, d, least, most):
        own = np.flatnonzero((labels == label) & (dims == d))
        own = own[~(bounds(vectors[own, :d], least, most)[1] < reached[own] - _slack(vectors[own, :d], least, most))]  # what can't be told is read
        done = by_block.get(block)
        return np.setdiff1d(own, done) if done else own

    rest = _read(blocks, _needed(blocks, others), len(labels), positives, positive).collect()
    lists: list[list] = [[] for _ in labels]
    for r in [*probe, *rest]:
        lists[r.list].append((-r.score, r.vec_id, r.uid))
    top, ids = np.zeros((len(labels), positives), np.int64), np.zeros((len(labels), positives), np.int64)
    has = np.zeros(top.shape, bool)
    for a, own in enumerate(lists):
        for p, (score, vec_id, _) in enumerate(sorted(own)[:positives]):
            top[a, p], ids[a, p], has[a, p] = -score, vec_id, True
    bottom = np.array([[-((-low * int(s)) // 100) if ok else 0 for s, ok in zip(row, good, strict=True)] for row, good in zip(top, has, strict=True)], object)  # the least whole number of the window
    bottom = np.clip(bottom, *ENDS).astype(np.int64).reshape(top.shape)
    open_window = has & (bottom <= top)

    def windows(block, label, d, least, most):
        own = np.flatnonzero((labels != label) & (dims == d) & open_window.any(axis=1))
        down, up = bounds(vectors[own, :d], least, most)
        slack = _slack(vectors[own, :d], least, most)
        return own[(open_window[own] & ~(bottom[own] > (up + slack)[:, None]) & ~(top[own] < (down - slack)[:, None])).any(axis=1)]

    def negative(best_rows, x, ids, uids, anchors):
        found = scores(x, vectors[anchors, : x.shape[1]])
        for p in range(positives):
            use = open_window[anchors, p]
            some, these = found[:, use], anchors[use]
            allowed = (some <= top[these, p]) & (some >= bottom[these, p])
            best_rows.add(these * positives + p, *_kept(some, ids, uids, allowed, best_rows.k))

    mined = _read(blocks, _needed(blocks, windows), len(labels) * positives, negatives, negative)
    a, p = np.nonzero(open_window)
    known = pa.table({"list": pa.array((a * positives + p).astype(np.int32)), "anchor_id": group["vec_id"][a], "positive_id": ids[a, p], "positive_score": top[a, p]})
    return mined, known


def _slack(anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How far the bounds can be off by rounding in doubles; 0 for whole numbers of up to 53 bits."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.abs(anchors) @ np.maximum(np.abs(least), np.abs(most))
    return np.where(size < EXACT, 0.0, size * 1e-12)


def hard_negatives(vectors: DataFrame, anchor_every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, block: int = BLOCK, group_bytes: int = GROUP, probes: int = PROBES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``vectors`` has vec_id, embedding and label; anchors are the rows whose vec_id ``anchor_every`` divides.
    """
    spark = vectors.sparkSession
    rows = materialise(prepared(vectors), "whole-vectors")
    blocks = build_blocks(rows, block)
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    widest = max(1, rows.agg(F.max(F.size("q"))).first()[0] or 1)
    size = max(1, group_bytes // (8 * widest))
    groups = -(-anchors.count() // size)
    numbered = materialise(anchors.withColumn("g", F.pmod(F.xxhash64("uid"), F.lit(max(1, groups)))), "anchors")
    out = None
    for g in range(groups):
        own = numbered.where(F.col("g") == g).orderBy("uid").toArrow()  # about group_bytes
        if not own.num_rows:
            continue
        column = lambda c, own=own: own.column(c).combine_chunks()
        d = column("q").value_lengths().to_numpy().astype(np.int64)
        q = np.zeros((own.num_rows, widest))
        q[np.arange(widest)[None, :] < d[:, None]] = column("q").flatten().to_numpy()
        group = {"q": q, "d": d} | {c: column(c).to_numpy() for c in ("label", "uid", "vec_id")}
        mined, known = _group_rows(group, blocks, positives, negatives, low, probes)
        one = mined.join(spark.createDataFrame(known), "list").select("anchor_id", F.when(F.col("positive_id") != ENDS[1], F.col("positive_id")).alias("positive_id"), (F.col("place") + 1).alias("rank"), F.when(F.col("vec_id") != ENDS[1], F.col("vec_id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        one = materialise(one, "negatives")
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") if out is None else out


SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
