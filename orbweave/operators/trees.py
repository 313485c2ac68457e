"""Boosted trees on squared errors: tasks that hold all rows of several fits grow the trees side by side.

Features are cut into bins once, and rows are dealt to the tasks of one barrier stage as bins (a byte a value), which
stay there for all rounds. At each level of a tree a task writes its sums of errors and counts per node, feature and bin
to the shared folder, adds up all tasks' sums of its share of the features, and tells the others the best splits there;
what is exchanged doesn't depend on the rows. Errors enter the sums as integers, so trees don't depend on partitions or order.
"""

from __future__ import annotations

import math
import mmap
import pickle
import tempfile
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.storage import open_folder, release, shared_path

BINS = 32
GRID = 256  # quantiles asked for a feature
SUMMARY, SUMMARIES = 2048, 32  # points that stand for a chunk's values, and how many such summaries become one; each such step moves ranks by 1/4096 at most
CHUNK = 1 << 16  # rows
TOGETHER = 1 << 15, 1 << 10  # bins of several features, counted in one go for one node, and a node for many
COUNT, UNITS = float(1 << 36), (1 << 19) - 1  # a row counts as COUNT and as its error in -UNITS to UNITS: sums over a chunk are exact in a double
PENALTY, LEAST_GAIN = 1.0, 1e-6  # L2 on leaf values
SHARE = 0.85  # of rows and of features that a tree sees
CHECKPOINT_EVERY = 50  # rounds, after which the trees so far are kept for another attempt of the stage
ROWS_A_TASK = 1 << 14  # at least, so that small tables take few tasks


@dataclass(frozen=True)
class BoostedTrees:
    """``start`` plus a leaf value of every tree. Nodes are in heap order; a row goes right if its bin is above the cut."""

    bounds: list[np.ndarray]  # a value's bin is the number of bounds below it
    start: float
    features: np.ndarray  # trees x nodes
    cuts: np.ndarray
    values: np.ndarray  # trees x leaves

    @property
    def getNumTrees(self) -> int:  # noqa: N802, as Spark ML's models have it
        return len(self.values)

    def predict(self, columns: list[np.ndarray]) -> np.ndarray:
        x = _binned(columns, self.bounds)
        said = np.full(x.shape[1], self.start)
        for feature, cut, value in zip(self.features, self.cuts, self.values, strict=True):
            said += value.take(_places(x, feature, cut, len(value).bit_length() - 1))
        return said


def _binned(columns: list[np.ndarray], bounds: list[np.ndarray]) -> np.ndarray:
    """Features x rows; NaN is above all bounds."""
    return np.stack([np.searchsorted(b, c, side="left").astype(np.uint8) for c, b in zip(columns, bounds, strict=True)])


def _places(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Each row's place among the nodes of a level."""
    at = np.zeros(x.shape[1], np.min_scalar_type((1 << levels) - 1))
    for d in range(levels):
        at = _below(x, feature, cut, d, at)
    return at


def _below(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int, at: np.ndarray) -> np.ndarray:
    """The places one level below those at ``level``."""
    right, first = np.zeros(len(at), bool), (1 << level) - 1
    for node in range(1 << level):  # bytes compared with one byte are much faster than bytes gathered row by row
        if cut[first + node] < 255:
            right |= (at == node) & (x[feature[first + node]] > cut[first + node])
    return 2 * at + right


def _groups(bins: np.ndarray, most: int) -> list[list[int]]:
    """Columns that are counted together, in ``most`` bins of all of them at most."""
    found, size = [[]], 1
    for i in np.argsort(bins, kind="stable"):
        if size * bins[i] > most:
            found.append([])
            size = 1
        found[-1].append(int(i))
        size *= int(bins[i])
    return found


def _drawn(keys: np.ndarray, salt: int) -> np.ndarray:
    """Which rows a tree sees, by a hash of each row's key and the round."""
    z = keys + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z < np.uint64(int(SHARE * (1 << 64)))


@dataclass
class _Growing:
    """A fit between two levels: its last tree as far as grown, and the sums of that tree's last level."""

    depth: int
    bound: float  # no error is larger
    salt: int = 0
    columns: np.ndarray | None = None
    feature: np.ndarray | None = None
    cut: np.ndarray | None = None
    value: np.ndarray | None = None
    sums: np.ndarray | None = None  # nodes x features x bins x (errors in units, rows)
    asked: np.ndarray | None = None  # of each node of the level: its slot in the tasks' sums, or -1
    mine: slice = slice(None)  # the columns whose sums this task adds up
    bins: np.ndarray | None = None  # of each feature, where not all have BINS

    @property
    def unit(self) -> float:
        return (self.bound or 1.0) / UNITS

    def begin(self, width: int, salt: int) -> None:
        nodes = (1 << self.depth) - 1
        self.salt, self.sums, self.asked = salt, None, np.zeros(1, np.int64)
        self.columns = np.sort(np.random.default_rng(salt).permutation(width)[: max(1, int(SHARE * width))])
        self.feature, self.cut, self.value = np.zeros(nodes, np.int64), np.full(nodes, 255, np.uint8), None

    def task(self, level: int) -> tuple:
        return level, self.salt, self.columns, self.feature, self.cut, self.asked, self.unit, np.full(len(self.columns), BINS) if self.bins is None else self.bins[self.columns]

    def take(self, level: int, told: np.ndarray | None) -> None:
        """Split the level's nodes by what was ``told``: the sums of the root, or of each parent's smaller child."""
        self.split(level, [self.best(told)])

    def best(self, told: np.ndarray | None) -> tuple[np.ndarray, ...] | None:
        """Of each node of the level the best split by ``mine``, this task's share of the columns: its gain, column, cut, rows and errors to the left; and all rows and errors."""
        columns = np.arange(len(self.columns))[self.mine]
        told = np.zeros((2, len(columns), 1 + int(self.asked.max()), BINS)) if told is None else told
        told = told.transpose(2, 1, 3, 0)
        if self.sums is None:
            self.sums = told
        else:  # a child that was not asked for is its parent less its sibling; where the parent stays whole, it goes left
            made = np.zeros((2 * len(self.sums), *told.shape[1:]))
            for parent, whole in enumerate(self.sums):
                pair = 2 * parent, 2 * parent + 1
                small, large = pair if self.asked[pair[0]] >= 0 else pair[::-1]
                if self.asked[small] >= 0:
                    made[small] = told[self.asked[small]]
                made[large] = whole - made[small]
            self.sums = made
        if not len(columns):
            return None
        below = self.sums.cumsum(2)
        all_, g, n = below[:, :1, -1:, :], below[..., 0] * self.unit, below[..., 1]
        total, rows = all_[..., 0] * self.unit, all_[..., 1]
        gain = np.where((n >= 1) & (rows - n >= 1), g * g / (n + PENALTY) + (total - g) ** 2 / (rows - n + PENALTY) - total * total / (rows + PENALTY), -1.0)
        flat = gain.reshape(len(gain), -1)
        best, node = flat.argmax(1), np.arange(len(gain))
        column, cut = best // BINS, best % BINS
        return flat[node, best], columns[column], cut, n[node, column, cut], g[node, column, cut], rows[:, 0, 0], total[:, 0, 0]

    def split(self, level: int, bests: list[tuple | None]) -> None:
        """Split the level's nodes by the best of the tasks' splits, those of the first columns where gains are equal."""
        first, *others = [b for b in bests if b is not None]
        gain, column, cut, n, g, rows, total = first
        for other in others:
            better = other[0] > gain
            gain, column, cut, n, g = (np.where(better, b, a) for a, b in zip((gain, column, cut, n, g), other, strict=False))
        split, at = gain > LEAST_GAIN, (1 << level) - 1
        self.feature[at : at + len(gain)] = np.where(split, self.columns[column], 0)
        self.cut[at : at + len(gain)] = np.where(split, cut, 255)
        left = np.where(split, n, rows)
        if level + 1 < self.depth:
            smaller = np.stack([left <= rows - left, left > rows - left], 1) & split[:, None]
            self.asked = np.where(smaller.ravel(), np.cumsum(smaller.ravel()) - 1, -1)
        else:
            mean = np.where(split, g, total)
            self.value = np.stack([mean / (left + PENALTY), (total - mean) / (rows - left + PENALTY)], 1).ravel()

    def end(self, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.value *= rate
        self.bound += float(np.abs(self.value).max())
        return self.feature, self.cut, self.value


def _histograms(tasks: dict[int, tuple], chunks: Iterable[tuple]) -> Iterator[dict[int, np.ndarray]]:
    """The sums of a task's chunks, of each fit. Chunks may bring along which rows are drawn, and these rows' places."""
    out: dict[int, np.ndarray] = {}
    for fit, x, keys, error, *known in chunks:
        level, salt, columns, feature, cut, asked, unit, bins = tasks[fit]
        slots = 1 + int(asked.max())
        if not slots:
            continue
        drawn, at = known or (_drawn(keys, salt), _places(x, feature, cut, level))
        slot = asked.take(at)
        rows = np.flatnonzero(drawn & (slot >= 0))
        slot, weight = slot.take(rows), COUNT + np.rint(error.take(rows) / unit)
        both = np.zeros((len(columns), slots, BINS))
        for group in _groups(bins, TOGETHER[slots > 1]):  # of the bins of a whole group the sums of each column's own are exact too
            size, code = math.prod(bins[i] for i in group), x[columns[group[0]]]
            for i in group[1:]:
                code = code.astype(np.uint16) * np.uint16(bins[i]) + x[columns[i]]
            code = code.take(rows).astype(np.int64)
            if slots > 1:
                code += slot * size
            made, after = np.bincount(code, weights=weight, minlength=slots * size), size
            for i in group:
                before, after = size // after, after // bins[i]
                own = made.reshape(slots, before * bins[i], after)
                own = own @ np.ones(after) if after > 1 else own
                both[i, :, : bins[i]] = np.ones(before) @ own.reshape(slots, before, bins[i])
        n = np.floor(both / COUNT + 0.5)
        own = np.stack([both - n * COUNT, n])
        out[fit] = out[fit] + own if fit in out else own
    yield out


def _added(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in a.keys() | b.keys()}


class _Rows:
    """A task's rows as chunks: bins and keys in a local file that is read through a memory map; errors, draws and places in memory."""

    def __init__(self, parts: Iterable[tuple]):
        self.file, self.fits, self.errors, at = tempfile.TemporaryFile(), [], [], []
        held: dict[int, list[tuple]] = {}
        for fit, x, keys, error in parts:
            own = held.setdefault(fit, [])
            if sum(len(e) for *_, e in own) + len(error) > CHUNK:
                at.append(self._kept(fit, own))
                own.clear()
            own.append((x, keys, error))
        at += [self._kept(fit, own) for fit, own in held.items()]
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ) if at else None
        self.bins = [np.frombuffer(self.map, np.uint8, width * n, start).reshape(width, n) for start, width, n in at]
        self.keys = [np.frombuffer(self.map, np.uint64, n, start + -(-width * n // 8) * 8) for start, width, n in at]
        self.drawn, self.at = [], []

    def _kept(self, fit: int, parts: list[tuple]) -> tuple[int, int, int]:
        x, keys, error = (np.concatenate(p, axis=-1) for p in zip(*parts, strict=True))
        start = self.file.tell()
        self.file.write(x.tobytes() + bytes(-x.size % 8) + keys.tobytes())
        self.fits.append(fit)
        self.errors.append(error)
        return start, *x.shape

    def begin(self, growing: dict[int, _Growing]) -> None:
        self.drawn = [_drawn(k, growing[fit].salt) for fit, k in zip(self.fits, self.keys, strict=True)]
        self.at = [np.zeros(len(k), np.min_scalar_type((1 << growing[fit].depth) - 1)) for fit, k in zip(self.fits, self.keys, strict=True)]

    def chunks(self) -> Iterator[tuple]:
        return zip(self.fits, self.bins, self.keys, self.errors, self.drawn, self.at, strict=True)

    def descend(self, growing: dict[int, _Growing], level: int) -> None:
        for i, (fit, x) in enumerate(zip(self.fits, self.bins, strict=True)):
            g = growing[fit]
            self.at[i] = _below(x, g.feature, g.cut, level, self.at[i])

    def learn(self, values: dict[int, np.ndarray]) -> None:
        for fit, error, at in zip(self.fits, self.errors, self.at, strict=True):
            error -= values[fit].take(at)

    def relearn(self, trees: dict[int, list[tuple]]) -> None:
        """The errors after trees of an earlier attempt."""
        for fit, x, error in zip(self.fits, self.bins, self.errors, strict=True):
            for feature, cut, value in trees[fit]:
                error -= value.take(_places(x, feature, cut, len(value).bit_length() - 1))


class _Exchange:
    """Between the tasks of a stage: sums and messages through files of the shared folder (a call of the stage's own barrier takes a second)."""

    def __init__(self, context: BarrierTaskContext, folder: str):
        self.task, self.tasks, self.steps, self.last = context.partitionId(), len(context.getTaskInfos()), 0, None
        self.fs, self.root = open_folder(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.attempt = context.allGather(str(context.taskAttemptId()))[0]

    def _shared(self, data: list[bytes]) -> list[str]:
        """The files of all tasks, once all are written; then all have read those of the step before."""
        self.steps += 1
        names = [f"{self.root}/{self.attempt}-{self.steps}-{task}" for task in range(self.tasks)]
        with self.fs.open_output_stream(f"{names[self.task]}.part") as out:
            for d in data:
                out.write(d)
        self.fs.move(f"{names[self.task]}.part", names[self.task])
        missing, pause = names, 0.0005
        while missing := [i.path for i in self.fs.get_file_info(missing) if i.type == fs.FileType.NotFound]:
            time.sleep(pause)
            pause = min(2 * pause, 0.02)
        if self.last:
            self.fs.delete_file(self.last)
        self.last = names[self.task]
        return names

    def said(self, what) -> list:
        """What every task says."""
        if self.tasks == 1:
            return [what]
        told = []
        for name in self._shared([pickle.dumps(what)]):
            with self.fs.open_input_file(name) as file:
                told.append(pickle.loads(file.read()))
        return told

    def added(self, own: dict[int, np.ndarray], mine: dict[int, slice]) -> dict[int, np.ndarray]:
        """All tasks' sums of ``mine``."""
        if self.tasks == 1 or not own:
            return own
        told = {}
        for name in self._shared([np.ascontiguousarray(own[k].transpose(1, 0, 2, 3)).tobytes() for k in sorted(own)]):
            start = 0
            with self.fs.open_input_file(name) as file:
                for k in sorted(own):
                    kinds, width, slots, bins = own[k].shape
                    size, (low, high, _) = kinds * slots * bins * 8, mine[k].indices(width)
                    if high > low:
                        read = np.frombuffer(file.read_at(size * (high - low), start + size * low)).reshape(high - low, kinds, slots, bins)
                        told[k] = told[k] + read if k in told else read
                    start += size * width
        return {k: t.transpose(1, 0, 2, 3) for k, t in told.items()}

    def keep(self, what) -> None:
        """For another attempt of the stage."""
        with self.fs.open_output_stream(f"{self.root}/.kept") as out:
            out.write(pickle.dumps(what))
        self.fs.move(f"{self.root}/.kept", f"{self.root}/kept")

    def kept(self):
        if self.fs.get_file_info(f"{self.root}/kept").type == fs.FileType.NotFound:
            return None
        with self.fs.open_input_file(f"{self.root}/kept") as file:
            return pickle.loads(file.read())


def _grown(parts: Iterable[tuple], growing: dict[int, _Growing], widths: dict[int, int], folder: str, rounds: int, depth: int, rate: float, seed: int) -> Iterator[dict[int, list[tuple]]]:
    """A task of the stage; the first one tells the trees."""
    exchange, rows = _Exchange(BarrierTaskContext.get(), folder), _Rows(parts)
    found = exchange.kept() or {k: [] for k in growing}
    done = exchange.said(min(map(len, found.values())))[0]
    rows.relearn(found)
    for k, g in growing.items():
        g.bound += sum(float(np.abs(value).max()) for *_, value in found[k])
        g.begin(widths[k], 0)
    share, before = [sum(len(g.columns) for g in growing.values()) * (exchange.task + i) // exchange.tasks for i in (0, 1)], 0
    for g in growing.values():
        g.mine = slice(*(min(max(s - before, 0), len(g.columns)) for s in share))
        before += len(g.columns)
    mine = {k: g.mine for k, g in growing.items()}
    for t in range(done, rounds):
        for k, g in growing.items():
            g.begin(widths[k], seed * 1_000_003 + t)
        rows.begin(growing)
        for level in range(depth):
            tasks = {k: g.task(level) for k, g in growing.items()}
            own = next(_histograms(tasks, rows.chunks()))
            empty = {k: np.zeros((2, len(g.columns), 1 + int(g.asked.max()), BINS)) for k, g in growing.items() if g.asked.max() >= 0 and k not in own}
            told = exchange.added(own | empty, mine)
            bests = exchange.said({k: g.best(told.get(k)) for k, g in growing.items()})
            for k, g in growing.items():
                g.split(level, [b[k] for b in bests])
            rows.descend(growing, level)
        for k, g in growing.items():
            found[k].append(g.end(rate))
        rows.learn({k: of[-1][2] for k, of in found.items()})
        if exchange.task == 0 and (t + 1) % CHECKPOINT_EVERY == 0 and t + 1 < rounds:
            exchange.keep(found)
    if exchange.task == 0:
        yield found


def _unpacked(row) -> tuple:
    x, keys, error = (np.frombuffer(bytes(b), kind) for b, kind in zip(row[2:], (np.uint8, np.uint64, np.float64), strict=True))
    return row[1], x.reshape(-1, len(keys)), keys, error


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of CHUNK rows at most: features and target as doubles, null as 0, the keys' hash, and the fits' bits."""
    held: list[pa.RecordBatch] = []

    def made():
        table = pa.Table.from_batches(held)
        for at in range(0, table.num_rows, CHUNK):
            *x, h, of = table.slice(at, CHUNK).columns
            yield [*[pc.fill_null(c.cast(pa.float64(), safe=False), 0.0).to_numpy() for c in x], h.to_numpy(), of.to_numpy()]

    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= CHUNK:
            yield from made()
            held.clear()
    if held:
        yield from made()


def _hashed(columns: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    """A key for each row from all its columns and the hash of its keys."""
    z = h.astype(np.int64).view(np.uint64).copy()
    for c in columns:
        z ^= (c + 0.0).view(np.uint64)
        z *= np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(32)
    return z


def _condensed(parts: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Sorted points, SUMMARY at most, and how many rows each stands for, of ``parts`` of this kind."""
    points, weights = np.concatenate([p for p, _ in parts]), np.repeat([w for _, w in parts], [len(p) for p, _ in parts])
    order = points.argsort(kind="stable")
    points, below = points[order], weights[order].cumsum()
    if len(points) <= SUMMARY and len({w for _, w in parts}) == 1:
        return points, parts[0][1]
    return points[below.searchsorted((np.arange(SUMMARY) + 0.5) * below[-1] / SUMMARY)], below[-1] / SUMMARY


def _of_fits(fits: list[int], batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Chunks of each fit: the rows whose last column, a number of bits, has the fit's."""
    for *columns, of in _chunks(batches):
        for i, fit in enumerate(fits):
            own = (of >> i) & 1 == 1
            if own.all():
                yield fit, columns
            elif own.any():
                yield fit, [c[own] for c in columns]


def _summaries(fits: list[int], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per fit, column and summary of its values, NaN left out; column -1 has rows, sum, least and largest of the targets."""
    found = {fit: _Summary() for fit in fits}
    for fit, columns in _of_fits(fits, batches):
        found[fit].add(columns)
    for fit, summary in found.items():
        yield from summary.rows(fit)


class _Summary:
    def __init__(self):
        self.levels: list[list[list[tuple]]] = [[]]
        self.y = np.zeros((0, 4))

    def add(self, columns: list[np.ndarray]) -> None:
        *x, y, _ = columns
        self.y = np.concatenate([self.y, [[len(y), y.sum(), y.min(), y.max()]]])
        self.levels[0].append([_condensed([(np.sort(c[~np.isnan(c)]), 1.0)]) for c in x])
        for i, of in enumerate(self.levels):
            if len(of) == SUMMARIES:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append([_condensed(list(c)) for c in zip(*of, strict=True)])
                of.clear()

    def rows(self, fit: int) -> Iterator[pa.RecordBatch]:
        if len(self.y):
            told = [(i, *_condensed(list(c))) for i, c in enumerate(zip(*[p for of in self.levels for p in of], strict=True))]
            told.append((-1, np.array([self.y[:, 0].sum(), self.y[:, 1].sum(), self.y[:, 2].min(), self.y[:, 3].max()]), 1.0))
            yield pa.RecordBatch.from_arrays([pa.array([fit] * len(told)), pa.array([i for i, *_ in told]), pa.array([p.tobytes() for _, p, _ in told], pa.binary()), pa.array([float(w) for *_, w in told])], ["fit", "column", "points", "weight"])


def _quantiles(of: pd.DataFrame) -> pd.DataFrame:
    """A column's quantiles from all its summaries."""
    parts = [np.frombuffer(p) for p in of.points]
    if of.column[0] < 0:
        y = np.stack(parts)
        told = np.array([y[:, 0].sum(), y[:, 1].sum() / y[:, 0].sum(), y[:, 2].min(), y[:, 3].max()])
    else:
        points, weights = np.concatenate(parts), np.repeat(of.weight.to_numpy(), [len(p) for p in parts])
        order = points.argsort(kind="stable")
        below = weights[order].cumsum()
        told = points[order][below.searchsorted(np.arange(1, GRID) / GRID * below[-1] * (1 - 1e-12))] if len(points) else points
    return pd.DataFrame({"fit": of.fit[:1], "column": of.column[:1], "told": [told.tolist()]})


def _bounds(values: np.ndarray) -> np.ndarray:
    """Of a feature's quantiles some and, where these fall together, values between. A bin at either end has at least one
    row in ``GRID``: a cut that parts off fewer would make leaves of single outliers, such as rows of a last day."""
    every = np.unique(values)[:-1]
    evenly = np.intersect1d(values[GRID // BINS - 1 :: GRID // BINS], every)
    rest = np.setdiff1d(every, evenly)
    more = min(BINS - 1 - len(evenly), len(rest))
    return np.union1d(evenly, rest[np.linspace(0, len(rest) - 1, more).astype(int)])


def _packed(fits: list[int], bounds: dict[int, list[np.ndarray]], start: dict[int, float], tasks: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of bins, keys and errors of each fit, cut evenly for all tasks."""
    for i, (fit, (*x, y, keys)) in enumerate(_of_fits(fits, batches)):
        packed = _binned(x, bounds[fit]), _hashed([*x, y], keys), y - start[fit]
        edges = np.linspace(0, len(y), tasks + 1).astype(int)
        cut = [((i + k) % tasks, slice(a, b)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        parts = [pa.array([np.ascontiguousarray(p[..., own]).tobytes() for _, own in cut], pa.binary()) for p in packed]
        yield pa.RecordBatch.from_arrays([pa.array([to for to, _ in cut], pa.int32()), pa.array([fit] * len(cut)), *parts], ["task", "fit", "x", "keys", "error"])


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    first, *others = frames
    for f in others:
        first = first.union(f)
    return first


def boosted_fits(fits: list[tuple[DataFrame, list[str]]], target: str, keys: tuple[str, ...], rounds: int, depth: int, rate: float, seed: int, where: list[Column] | None = None) -> list[BoostedTrees]:
    """A model for each pair of rows and features; all fits grow in one barrier stage, a task a free core at most.

    A tree sees a share of the rows, by a hash of the row (``keys`` and all that the fit reads of it), and of the features.
    Fits of one frame and feature list, each of the rows that its part of ``where`` names, share the scans (62 fits at most).
    """
    spark = fits[0][0].sparkSession
    context = spark.sparkContext._jsc.sc()
    scans: dict[tuple, list[int]] = {}
    for fit, (frame, features) in enumerate(fits):
        scans.setdefault((id(frame), tuple(features)), []).append(fit)
    frames = []
    for (_, features), of in scans.items():
        frame = fits[of[0]][0]
        named = [k for k in keys if k in frame.columns]
        bits = sum((F.when(where[fit], F.lit(1 << i)).otherwise(F.lit(0)) for i, fit in enumerate(of)), F.lit(0).cast("long")) if where else F.lit((1 << len(of)) - 1).cast("long")
        label = F.col(target).cast("double")
        wrong = (bits > 0) & (label.isNull() | F.isnan(label) | (F.abs(label) == float("inf")))
        label = F.when(wrong, F.raise_error(F.lit("a target to learn from is no finite number"))).otherwise(label)
        plain = {c for c, kind in frame.dtypes if kind in ("int", "bigint", "float", "double", "smallint", "tinyint")}
        frames.append((of, frame.select(*[(F.col(c) if c in plain else F.col(c).cast("double")).alias(f"f{i}") for i, c in enumerate(features)], label.alias("y"), (F.xxhash64(*named) if named else F.lit(0).cast("long")).alias("h"), bits.alias("of"))))
    summaries = _union([rows.mapInArrow(lambda batches, of=of: _summaries(of, batches), "fit long, column long, points binary, weight double") for of, rows in frames])
    told = {(r.fit, r.column): np.array(r.told) for r in summaries.groupBy("fit", "column").applyInPandas(_quantiles, "fit long, column long, told array<double>").collect()}
    bounds = {fit: [_bounds(told[fit, i]) if (fit, i) in told else np.empty(0) for i in range(len(features))] for fit, (_, features) in enumerate(fits)}
    sums = {fit: told[fit, -1] for fit in range(len(fits)) if (fit, -1) in told}
    start = {fit: float(np.float32(mean)) for fit, (_, mean, _, _) in sums.items()}
    grown = {}
    if sums and rounds:
        slots = context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())
        tasks = max(1, min(slots, math.ceil(sum(s[0] for s in sums.values()) / ROWS_A_TASK)))
        growing = {fit: _Growing(depth, max(abs(low - start[fit]), abs(high - start[fit])), bins=np.array([len(b) + 1 for b in bounds[fit]])) for fit, (_, _, low, high) in sums.items()}
        widths, folder = {fit: len(fits[fit][1]) for fit in sums}, shared_path(spark, "growing")
        dealt = _union([rows.mapInArrow(lambda batches, of=of: _packed(of, bounds, start, tasks, batches), "task int, fit long, x binary, keys binary, error binary") for of, rows in frames]).repartitionById(tasks, F.col("task"))
        try:
            made = dealt.rdd.barrier().mapPartitions(lambda rows: _grown(map(_unpacked, rows), growing, widths, folder, rounds, depth, rate, seed))
            grown = made.coalesce(1, shuffle=True).collect()[0]  # a barrier stage is tried again only in front of a shuffle
        finally:
            release(spark, [folder])
    stacked = lambda fit: [np.stack(part) for part in zip(*grown[fit], strict=True)] if fit in grown else [np.empty((0, 0))] * 3
    return [BoostedTrees(bounds[fit], start.get(fit, 0.0), *stacked(fit)) for fit in range(len(fits))]
