"""Approximate nearest neighbours by learned partitions.

1. *Graph.* A bounded sample of the distinct vectors is joined to its exact nearest neighbours within the sample.
2. *Balanced partitioning.* The sample graph is cut into parts of equal capacity: labels start from balanced seeds, then
   vertices move, most gain first, to the part that holds most of their neighbours while it has room.
3. *Router.* A small softmax classifier learns to tell a vector's part from the vector.
4. *Second level.* Steps 1 to 3 are repeated inside each part, on a sample of its vectors, in a task of its own. For n
   distinct vectors there are about the fourth root of n parts with as many leaves each: about sqrt(n) leaves of sqrt(n)
   vectors. A leaf's probability is its part's times its own inside the part.
5. *Index.* Every vector of the table is put in its most probable leaf.
6. *Search.* A query visits its most probable leaves until their probabilities add up to a mass, and ranks what it finds
   there by the exact inner product in double precision. The mass is the one at which ``recall`` of the exact neighbours
   are found in a calibration sample (other vectors than those learnt from, where the table has enough); as many are looked
   for there as are to be expected in a sample. In small samples of large tables the nearest lies farther away than the
   neighbours in the whole table, so it errs on the side of more leaves.

The search is a shuffle on cells: whole leaves together, or a block of a larger leaf, of up to a 16th of the table and
``CELL`` vectors at most. Every vector is sent once, to its cell, and a query once to each cell that holds leaves of its
own; what comes back is a list of ``k`` for each query and cell, so cells are large. A task holds a cell and streams its
queries past it, so its memory is that of a cell whatever the table's size or skew. Equal vectors are stored once with their ``k + 1`` smallest ids, which is all
that a result of ``k`` can need of them, so a vector that a third of the rows share costs nothing. What passes through the
driver is the samples, the routers and a count for each leaf and cell: about sqrt(n) rows of the vectors' length.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, neither as query nor as
candidate; rows with a null id take no part; with fewer candidates than ``k`` a query gets all that it visits; up to
``WHOLE`` distinct vectors are one leaf; ties go to the smaller id; vectors of another length than most are indexed apart
and compared with their own length only; repeated (id, vector) rows count once; of different vectors with one id the least
asks, and all are candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.storage import materialise

CELL, SMALL_CELL = 65_536, 4_096  # vectors; 34 MB at 64 components
HELD = 4_000_000  # probabilities held at once in a task
WHOLE = 64  # vectors for which no router can be learnt


@dataclass(frozen=True)
class AnnParams:
    k: int = 20
    sample: int = 4_096  # vectors that the first router is learnt from, or 64 for each of its parts if those are more
    sample_below: int = 2_048  # the same for a router inside a part
    neighbours: int = 10
    recall: float = 0.95  # aimed at in calibration
    probe: int = 512  # queries of the calibration sample
    epochs: int = 120


@dataclass(frozen=True)
class Router:
    weights: np.ndarray
    bias: np.ndarray
    scale: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.scale) @ self.weights + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Tree:
    """A router to parts, and for each part one to its leaves; leaves are numbered part by part."""

    top: Router
    below: list[Router]

    def first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([len(r.bias) for r in self.below])])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        top = self.top.probabilities(x)
        return np.concatenate([top[:, [i]] * r.probabilities(x) for i, r in enumerate(self.below)], axis=1)

    def in_pieces(self, x: np.ndarray):
        """Yields (rows, their probabilities of all leaves), at most about HELD numbers at once."""
        step = max(1, HELD // int(self.first()[-1]))
        for at in range(0, len(x), step):
            rows = np.arange(at, min(len(x), at + step))
            yield rows, self.probabilities(x[rows])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The most probable leaf of each vector."""
        return np.concatenate([prob.argmax(axis=1) for _, prob in self.in_pieces(x)])


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v): the rows that take part, v in double precision."""
    v = F.col(embedding).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & whole)
    return rows.where(F.exists("v", lambda x: x != 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(key, v, ids): each distinct vector once, with its k + 1 smallest ids; the limit is applied before the shuffle."""
    keyed = rows.distinct().withColumn("key", F.xxhash64("v"))
    first = keyed.withColumn("place", F.row_number().over(Window.partitionBy("key", "v").orderBy("id"))).where(F.col("place") <= k + 1)
    return first.groupBy("key", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    near = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        near[at : at + 1024] = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
    return near


def _with_room(wish: np.ndarray, parts: int, room: int) -> np.ndarray:
    """Each row's most wished part that still has room, rows of the clearest wish first."""
    ranked = np.argsort(-wish, axis=1)
    top = np.take_along_axis(wish, ranked[:, :2], axis=1)
    left, label = np.full(parts, room), np.empty(len(wish), np.int64)
    for i in np.argsort(-(top[:, 0] - top[:, -1]), kind="stable"):
        for p in ranked[i]:
            if left[p]:
                left[p] -= 1
                label[i] = p
                break
    return label


def balanced_partition(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """A part for each vertex: no part above ``slack`` times the mean, most edges inside parts."""
    room = int(np.ceil(slack * len(x) / parts))
    rng = np.random.default_rng(5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit[rng.choice(len(x), parts, replace=False)]
    for _ in range(8):  # seeds: balanced spherical means
        label = _with_room(unit @ centres.T, parts, room)
        centres = np.stack([unit[label == p].mean(axis=0) if (label == p).any() else unit[rng.integers(len(x))] for p in range(parts)])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-12
    for _ in range(rounds):  # refinement on the graph, both ends of an edge counted
        votes = np.zeros((len(x), parts))
        rows = np.repeat(np.arange(len(x)), near.shape[1])
        np.add.at(votes, (rows, label[near.ravel()]), 1.0)
        np.add.at(votes, (near.ravel(), label[rows]), 1.0)
        votes /= votes.sum(axis=1, keepdims=True)
        votes[np.arange(len(x)), label] += 0.1  # a tie stays where it is
        new = _with_room(votes + 0.25 * (unit @ centres.T), parts, room)
        if (new == label).mean() > 0.995:
            return new
        label = new
    return label


def fit_router(x: np.ndarray, parts: int, p: AnnParams) -> Router:
    """Partition the sample ``x`` into at most ``parts`` parts and train the softmax classifier by Adam on mini-batches."""
    parts = max(1, min(parts, len(x) // 16)) if len(x) > WHOLE else 1
    scale = 1.0 / max(float(np.sqrt((x**2).mean() * x.shape[1])), 1e-12) if len(x) else 1.0
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), scale)
    near = _neighbour_graph(x, p.neighbours)
    label = balanced_partition(x, near, parts)
    # soft targets: where a vector's neighbours are, so that borders are learnt as such
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), label[near.ravel()]), 0.5 / near.shape[1])
    target[np.arange(len(x)), label] += 0.5
    rng = np.random.default_rng(7)
    w, b, z = np.zeros((x.shape[1], parts)), np.zeros(parts), x * scale
    m, v, t = [0.0, 0.0], [0.0, 0.0], 0
    for epoch in range(p.epochs):
        rate = 0.1 * (1 - epoch / p.epochs) + 0.002
        order = rng.permutation(len(x))
        for at in range(0, len(x), 512):
            i = order[at : at + 512]
            q = z[i] @ w + b
            q = np.exp(q - q.max(axis=1, keepdims=True))
            d = (q / q.sum(axis=1, keepdims=True) - target[i]) / len(i)
            t += 1
            for j, (g, a) in enumerate(((z[i].T @ d + 1e-5 * w, w), (d.sum(axis=0), b))):
                m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
                a -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return Router(w, b, scale)


def fit_tree(base: DataFrame, n: int, p: AnnParams) -> Tree:
    """Both levels of routers for the ``n`` vectors of ``base`` (key, v)."""
    spark = base.sparkSession
    parts = max(1, round(n**0.25))
    first = lambda df, order, size: np.array(df.orderBy(*order).select("v").limit(size).toArrow().column("v").to_pylist(), np.float64)
    top = fit_router(first(base, ["key", "v"], max(p.sample, 64 * parts)), parts, p)
    shared = spark.sparkContext.broadcast(top)

    def deal(batches):
        for d in batches:
            if len(d):
                d["part"] = shared.value.probabilities(np.stack(d["v"].to_numpy())).argmax(axis=1)
                yield d[["part", "key", "v"]]

    dealt = materialise(base.select("key", "v").mapInPandas(deal, "part int, key long, v array<double>"), "dealt")
    order = F.row_number().over(Window.partitionBy("part").orderBy("key", "v"))
    some = dealt.withColumn("place", order).where(F.col("place") <= max(p.sample_below, 64 * parts))  # of each part

    def fit_below(rows: pd.DataFrame) -> pd.DataFrame:
        r = fit_router(np.stack(rows.sort_values("place")["v"].to_numpy()), parts, p)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "weights": [r.weights.ravel()], "bias": [r.bias], "scale": [r.scale]})

    below = {r.part: Router(np.array(r.weights).reshape(-1, len(r.bias)), np.array(r.bias), r.scale) for r in some.groupBy("part").applyInPandas(fit_below, "part int, weights array<double>, bias array<double>, scale double").collect()}
    whole = Router(np.zeros((len(top.weights), 1)), np.zeros(1), 1.0)
    return Tree(top, [below.get(i, whole) for i in range(len(top.bias))])


def calibrated_mass(x: np.ndarray, tree: Tree, p: AnnParams, total: int) -> float:
    """The probability mass at which queries find ``p.recall`` of their exact neighbours among ``x``.

    Of the ``p.k`` nearest of ``total`` vectors about ``p.k * len(x) / total`` are in the sample ``x``: so many, and one at
    least, are looked for there.
    """
    own, n = tree.leaf(x), min(p.probe, len(x))
    k = min(max(1, round(p.k * len(x) / max(1, total))), len(x) - 1)
    if k < 1:
        return 1.0
    ahead = []
    for asked, prob in tree.in_pieces(x[:n]):
        s = x[asked] @ x.T
        s[np.arange(len(asked)), asked] = -np.inf
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-prob, axis=1)
        ranked = np.take_along_axis(prob, order, axis=1)
        before = np.empty_like(ranked)
        np.put_along_axis(before, order, np.cumsum(ranked, axis=1) - ranked, axis=1)  # what is visited ahead of a leaf
        ahead.append(np.take_along_axis(before, own[near], axis=1).ravel())
    return float(np.quantile(np.concatenate(ahead), p.recall)) + 1e-9


def search(vectors: DataFrame, queries: DataFrame | None = None, p: AnnParams = AnnParams(), query_every: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` nearest found.

    ``vectors`` has vec_id and embedding. ``queries`` has the same columns; left out, they are the rows whose id is
    divisible by ``query_every``.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors), "vectors")
    asked = rows.where(F.col("id") % query_every == 0) if queries is None else usable(queries)
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    base = materialise(distinct_vectors(rows, p.k), "distinct-vectors")
    size = F.size("v")
    lengths = [(r.n, r["count"]) for r in base.groupBy(size.alias("n")).count().orderBy(F.desc("count"), "n").collect()]
    found = None
    for length, n in lengths:
        one = _search_one(spark, base.where(size == length), asked.where(size == length), n, p)
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= p.k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _cells(counts: dict[int, int], leaves: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf its first cell and its number of cells; leaves share a cell of up to ``most`` vectors, or have several."""
    cell, blocks, at, room = np.zeros(leaves, np.int64), np.ones(leaves, np.int64), -1, 0
    for leaf in range(leaves):
        n = counts.get(leaf, 0)
        if n > most:
            cell[leaf], blocks[leaf] = at + 1, -(-n // most)
            at, room = at + blocks[leaf], 0
            continue
        if n > room or at < 0:
            at, room = at + 1, most
        cell[leaf], room = at, room - n
    return cell, blocks


def _search_one(spark, base: DataFrame, asked: DataFrame, n: int, p: AnnParams) -> DataFrame:
    """The search among the ``n`` distinct vectors of one length."""
    tree = fit_tree(base, n, p)
    leaves = int(tree.first()[-1])
    # from the other end of the order of hashes than the sample learnt from
    other = base.orderBy(F.desc("key"), F.desc("v")).select("v").limit(2 * p.sample).toArrow().column("v").to_pylist()
    mass = calibrated_mass(np.array(other, np.float64), tree, p, n)
    shared = spark.sparkContext.broadcast(tree)

    def index(batches):
        for d in batches:
            if len(d):
                d["leaf"] = shared.value.leaf(np.stack(d["v"].to_numpy()))
                yield d[["v", "ids", "leaf", "key"]]

    indexed = materialise(base.select("v", "ids", "key").mapInPandas(index, "v array<double>, ids array<long>, leaf int, key long"), "leaves")
    counts = {r.leaf: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # a row per leaf
    cell_of, blocks_of = _cells(counts, leaves, min(CELL, max(SMALL_CELL, -(-n // 16))))
    filled = np.array([leaf in counts for leaf in range(leaves)])
    layout = spark.sparkContext.broadcast((cell_of, blocks_of, filled))

    def route(batches):
        cell, blocks, filled = layout.value
        for d in batches:
            if not len(d):
                continue
            visits = []
            for rows, prob in shared.value.in_pieces(np.stack(d["v"].to_numpy())):
                order = np.argsort(-prob, axis=1, kind="stable")
                ranked = np.take_along_axis(prob, order, axis=1)
                visited = np.cumsum(ranked, axis=1) - ranked < mass
                visits += [_visits(order[i][visited[i]], cell, blocks, filled) for i in range(len(rows))]
            d["visits"] = visits
            yield d[["id", "v", "visits"]]

    routed = asked.select("id", "v").mapInPandas(route, "id long, v array<double>, visits array<struct<cell: int, leaves: array<int>>>")
    routed = routed.select(F.explode("visits").alias("x"), "v", "id").select("x.cell", F.lit(1).alias("asks"), "v", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("int").alias("leaf"), "id", "x.leaves")
    place = spark.createDataFrame([(int(leaf), int(cell_of[leaf]), int(blocks_of[leaf])) for leaf in counts] or [(-1, -1, 1)], "leaf int, cell int, blocks int")
    cell = (F.col("cell") + F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).alias("cell")
    held = indexed.join(place, "leaf").select(cell, F.lit(0).alias("asks"), "v", "ids", "leaf", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<int>").alias("leaves"))
    met = held.unionByName(routed).repartition("cell").sortWithinPartitions("cell", "asks")
    return met.mapInPandas(lambda batches: _stream(batches, p.k), "query_id long, vec_id long, score double")


def _stream(batches, k: int):
    """The best of every cell: first come its vectors, which are held, then its queries, which stream by."""
    now, parts, rows = None, [], None
    for d in batches:
        for cell in pd.unique(d["cell"]):
            own = d[d["cell"] == cell]
            if cell != now:
                now, parts, rows = cell, [], None
            if (own["asks"] == 0).any():
                parts.append(own[own["asks"] == 0])
            asked = own[own["asks"] == 1]
            if len(asked) and parts:
                rows = pd.concat(parts) if rows is None else rows
                yield _meet(rows, asked, k)


def _visits(leaves: np.ndarray, cell: np.ndarray, blocks: np.ndarray, filled: np.ndarray) -> list[dict]:
    """The cells of a query's leaves, each with the leaves that it holds."""
    own: dict[int, list[int]] = {}
    for leaf in leaves[filled[leaves]].tolist():
        for block in range(blocks[leaf]):
            own.setdefault(int(cell[leaf]) + block, []).append(leaf)
    return [{"cell": c, "leaves": found} for c, found in own.items()]


def _meet(rows: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest of each query among the vectors of those leaves of a cell that it visits."""
    nothing = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
    if not len(rows) or not len(asked):
        return nothing
    x, ids, leaf = np.stack(rows["v"].to_numpy()), rows["ids"].to_numpy(), rows["leaf"].to_numpy()
    q, name = np.stack(asked["v"].to_numpy()), asked["id"].to_numpy()
    wants = np.repeat(np.arange(len(asked)), asked["leaves"].map(len).to_numpy())
    wanted = np.concatenate(asked["leaves"].to_numpy())
    most, found = k + 1, []
    for one in np.unique(leaf):
        own, who = np.flatnonzero(leaf == one), wants[wanted == one]
        for at in range(0, len(who), 512):
            some = who[at : at + 512]
            s = q[some] @ x[own].T
            # equal products may differ in the last bits of the matrix product: all near the cut are kept
            cut = -np.partition(-s, min(most, len(own)) - 1, axis=1)[:, min(most, len(own)) - 1]
            i, j = np.nonzero(s >= (cut - 1e-9 * (1 + np.abs(cut)))[:, None])
            found.append((some[i], own[j], s[i, j]))
    if not found:
        return nothing
    who, what, about = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((-about, who))
    who, what, about = who[order], what[order], about[order]
    first = np.flatnonzero(np.diff(who, prepend=-1))
    size = np.diff(np.append(first, len(who)))
    cut = about[first + np.minimum(size, most) - 1]
    kept = about >= np.repeat(cut - 1e-9 * (1 + np.abs(cut)), size)
    who, what = who[kept], what[kept]
    # each product alone, so that it does not depend on what it was computed with
    score = np.concatenate([(x[what[at : at + 65_536]] * q[who[at : at + 65_536]]).sum(axis=1) for at in range(0, len(who), 65_536)])
    many = np.array([len(v) for v in ids[what]])
    who, score, vec = np.repeat(who, many), np.repeat(score, many), np.concatenate(ids[what])
    other = vec != name[who]
    who, score, vec = who[other], score[other], vec[other]
    order = np.lexsort((vec, -score, who))
    who, score, vec = who[order], score[order], vec[order]
    rank = np.arange(len(who)) - np.repeat(first := np.flatnonzero(np.diff(who, prepend=-1)), np.diff(np.append(first, len(who))))
    best = rank < k
    return pd.DataFrame({"query_id": name[who[best]], "vec_id": vec[best], "score": score[best]})


def brute_force(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, k: int) -> dict[int, list[int]]:
    """The exact neighbours of some queries, for measuring recall in tests."""
    result = {}
    for q in asked:
        s = (x * x[np.flatnonzero(ids == q)[0]]).sum(axis=1)
        order = np.lexsort((ids, -s))
        result[int(q)] = [int(i) for i in ids[order] if i != q][:k]
    return result
