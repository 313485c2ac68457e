"""Benchmark decontamination with a distributed positional inverted index.

*Index.* ``build_index`` stores, for every document, its terms with the positions at which each occurs: a posting list per
(term, document), of all terms, whatever a benchmark asks for. A row holds at most ``SEGMENT`` words of a document and the
``reach`` words after them, so that no match is cut; longer documents have several rows. It names its terms once, spaced
out; their counts and positions follow each other, term by term, in two bytes each.

*Queries.* Benchmark items are cut into windows of ``width`` consecutive words (an item of fewer words is one window).
The words of a window are ordered by their counts over the whole corpus, rarest first.

*Matching.* A posting of the word at offset k at position p says that the window may start at p - k: the list is adjusted
by its offset. The adjusted lists of a window's rarest words are intersected first; of what is left, every further word is
looked up at its place. An *exact* match has all words at their offsets. A *proximity* match has at least ``share`` of them
at most ``slop`` places away from there (words replaced, put in or left out). As a match misses at most m = n - ceil(share
* n) words, at least two of its m + 2 rarest words are there: those lists are merged, and starts that two of them support
(for an exact phrase alone m = 0, and both rarest words must) are candidates.

Scale: the index is a table of document rows, built in one pass over the texts and read once per block of windows. A
block is a stated set of queries of at most about ``BLOCK_BYTES``, which is broadcast; there are as many blocks as the
benchmark needs. No posting is shuffled, so no term is a hot key. In a task, postings are taken in ranges of positions.
Hits are measured as unions of intervals, never word by word.

Edge cases: null or empty texts have no words, on both sides; items without words have no window, items without an id are
left out; windows shared by several items are looked up once; repeated documents are told apart by a row number; a
document without hits keeps its row with zero counts and the digest of an empty list; empty tables give an empty result or
no hits; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.storage import materialise

WIDTH = 10
SHARE = 0.8
SLOP = 1
SEGMENT = 65_000
HELD = 200_000  # words of documents that are indexed at once in a task
BLOCK_BYTES = 32 << 20
CHUNK = 200_000  # postings, and offset-adjusted ones, merged at once in a task
PLACES = 17  # bits of a position in a row of the index
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased: runs of digits, a-z and all that is not ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


class _Codes(dict):
    """word -> its number in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _packed(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    """``values`` as two-byte numbers, cut into rows of ``sizes``."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 2
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values.astype("<u2"))])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each row has, and all numbers."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return np.diff(ends) // 2, np.frombuffer(data.tobytes(), "<u2")


def _postings(segments: list[list[bytes]]) -> list[pa.Array]:
    """For each segment its terms, how often each occurs, and the positions, term by term; an empty one has the empty term, never."""
    codes = _Codes()
    sizes = np.array([len(s) for s in segments], np.int64)
    code = np.fromiter(map(codes.__getitem__, chain.from_iterable(segments)), np.int64, sizes.sum())
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = max(1, len(codes))
    key = np.sort(((np.repeat(np.arange(len(segments)), sizes) * total + code) << PLACES) | place)
    owner = key >> PLACES
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    per_segment = np.bincount(owner[first] // total, minlength=len(segments))
    names = pa.array([w.decode() for w in codes], pa.string()).take(pa.array(owner[first] % total))
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_segment)]), pa.int32()), names)
    empty = np.flatnonzero(per_segment == 0)
    freqs = np.insert(np.diff(np.append(first, len(key))), np.cumsum(per_segment)[empty], 0)
    return [pc.binary_join(listed, " "), _packed(np.maximum(per_segment, 1), freqs), _packed(sizes, key & ((1 << PLACES) - 1))]


def build_index(docs: DataFrame, reach: int = WIDTH + 2 * SLOP) -> DataFrame:
    """The index of ``docs`` (uid, doc_id, text): uid, doc_id, n_words, base (words before the row's), terms, freqs, positions."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            for uid, doc_id, text in zip(*b.columns, strict=True):
                found = words(text.as_py())
                for base in range(0, max(1, len(found)), SEGMENT):
                    part = found[base : base + SEGMENT + reach]
                    held.append((uid.as_py(), doc_id.as_py(), len(found), base, part))
                    size += len(part) + 1
                    if size > HELD:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    def flush(held):
        facts = [pa.array([h[i] for h in held], pa.int64()) for i in range(4)]
        return pa.RecordBatch.from_arrays([*facts, *_postings([h[4] for h in held])], ["uid", "doc_id", "n_words", "base", "terms", "freqs", "positions"])

    source = docs.select("uid", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "uid long, doc_id long, n_words long, base long, terms string, freqs binary, positions binary")


def item_words(items: DataFrame) -> DataFrame:
    """item_id and its list of words ``w``, of items that have any."""

    def run(batches):
        for b in batches:
            found = [[w.decode() for w in words(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], ["item_id", "w"])

    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null").mapInArrow(run, "item_id string, w array<string>").where("size(w) > 0")


def windows_of(items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (wid, w), and (wid, item_id)."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    cut = item_words(items).select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("w")).distinct()
    cut = materialise(cut, "item-windows")
    windows = materialise(cut.select("w").distinct().select(F.monotonically_increasing_id().alias("wid"), "w"), "windows")
    return windows, materialise(cut.join(windows, "w").select("wid", "item_id"), "windows-of-items")


def _codes_of(terms: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many terms each row has, and their places in ``vocabulary``, -1 for others."""
    listed = pc.split_pattern(terms, " ")
    code = pc.fill_null(pc.index_in(pc.list_flatten(listed), vocabulary), -1)
    return pc.list_value_length(listed).to_numpy(zero_copy_only=False), code.to_numpy(zero_copy_only=False)


def term_counts(index: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each term of ``vocabulary``, which is broadcast, occurs in the indexed texts; those that don't are left out."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        names = pa.array(shared.value, pa.string())
        total = np.zeros(len(names), np.int64)
        for b in batches:
            _, code = _codes_of(b.column("terms"), names)
            freq = _unpacked(b.column("freqs"))[1]
            total += np.bincount(code[code >= 0], freq[code >= 0], len(names)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["code", "n"])

    counted = index.select("terms", "freqs").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {vocabulary[r.code]: r.n for r in counted}


@dataclass(frozen=True)
class Queries:
    """A block of windows: ``term`` has a row per window (-1 behind its end), ``rare_*`` its rarest words, sorted by term."""

    vocabulary: pa.Array
    wid: np.ndarray
    n: np.ndarray
    term: np.ndarray
    enough: np.ndarray  # words that a proximity match has at least
    support: np.ndarray  # of the rarest words, those that it has at least
    rare_from: np.ndarray
    rare_window: np.ndarray
    rare_offset: np.ndarray

    @classmethod
    def of(cls, rows: list, counts: dict[str, int], width: int, share: float) -> Queries:
        """``rows`` of (wid, w), and how often words occur in the corpus."""
        vocabulary = sorted({t for r in rows for t in r.w})
        code = {t: i for i, t in enumerate(vocabulary)}
        term, rare, n, enough, support = np.full((len(rows), width), -1), [], [], [], []
        for i, r in enumerate(rows):
            size = len(r.w)
            least = math.ceil(share * size - 1e-9)
            look = min(size, size - least + 2)
            term[i, :size] = [code[t] for t in r.w]
            rare += [(code[r.w[k]], i, k) for k in sorted(range(size), key=lambda k: (counts.get(r.w[k], 0), k))[:look]]
            n.append(size), enough.append(least), support.append(look - (size - least))
        rare = np.array(sorted(rare), np.int64).reshape(-1, 3)
        start = np.searchsorted(rare[:, 0], np.arange(len(vocabulary) + 1))
        return cls(pa.array(vocabulary, pa.string()), np.array([r.wid for r in rows], np.int64), np.array(n), term, np.array(enough), np.array(support), start, rare[:, 1], rare[:, 2])


def _distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order; by a sort, which is many times faster here than a table of hashes."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _ranges(place: np.ndarray, load: np.ndarray, chunk: int):
    """Ranges [from, to) of the sorted ``place`` whose loads add up to about ``chunk``."""
    total = np.cumsum(load)
    cuts = np.unique(place[np.searchsorted(total, np.arange(chunk, int(total[-1]), chunk))]) if len(total) else np.array([], np.int64)
    edges = [int(place[0]) - (1 << PLACES - 1), *cuts.tolist(), int(place[-1]) + (1 << PLACES - 1)]
    return zip(edges[:-1], edges[1:], strict=True)


def intersect(terms: pa.Array, freqs: pa.Array, positions: pa.Array, q: Queries, slop: int, chunk: int = CHUNK):
    """Yields (row, window, start, exact?) arrays of the matches in some rows of the index, a few rows at a time."""
    sizes, code = _codes_of(terms, q.vocabulary)
    (_, freq), (held, at) = _unpacked(freqs), _unpacked(positions)
    first_term, first_place = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes, held))
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(first_place, first_place[begin] + chunk, "right")) - 1)
        own, places = slice(first_term[begin], first_term[end]), slice(first_place[begin], first_place[end])
        for row, *found in _intersect(np.repeat(np.arange(end - begin), sizes[begin:end]), code[own], freq[own], at[places], q, slop, chunk):
            yield row + begin, *found
        begin = end


def _intersect(row: np.ndarray, code: np.ndarray, freq: np.ndarray, at: np.ndarray, q: Queries, slop: int, chunk: int):
    asked = code >= 0
    if not asked.any():
        return
    at = at[np.repeat(asked, freq)].astype(np.int64)
    code, row = np.repeat(code[asked].astype(np.int64), freq[asked]), np.repeat(row[asked], freq[asked])
    spot = (row << PLACES) + at  # a place among all rows
    bits = int(row[-1] + 1).bit_length() + PLACES
    lists = np.sort((code << bits) | spot)
    order = np.argsort(spot, kind="stable")
    spot, code = spot[order], code[order]
    load = q.rare_from[code + 1] - q.rare_from[code]
    spot, code, load = spot[load > 0], code[load > 0], load[load > 0]
    if not len(spot):
        return
    width = q.term.shape[1]

    def there(code, spot):
        key = (code << bits) | spot
        i = np.minimum(np.searchsorted(lists, key), len(lists) - 1)
        return (code >= 0) & (spot >= 0) & (lists[i] == key)

    for lo, hi in _ranges(spot, load, chunk):
        i, j = np.searchsorted(spot, [lo - slop, hi + width + slop])
        own = load[i:j]
        entry = np.repeat(q.rare_from[code[i:j]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        window, offset = q.rare_window[entry], q.rare_offset[entry]
        start = np.repeat(spot[i:j], own) - offset
        near = (start[:, None] + np.arange(-slop, slop + 1)).ravel()  # each list, adjusted by its offset, and moved by what may be missing
        window, offset = (np.repeat(x, 2 * slop + 1) for x in (window, offset))
        own = (near >= lo) & (near < hi)
        key = _distinct(((window[own] << 34 | (near[own] + (1 << PLACES))) << 6) | offset[own]) >> 6
        first = np.flatnonzero(np.diff(key, prepend=-1))
        held = np.diff(np.append(first, len(key)))
        key = key[first]
        window, start = key >> 34, (key & ((1 << 34) - 1)) - (1 << PLACES)
        some = held >= q.support[window]
        window, start = window[some], start[some]
        exact, hits = np.ones(len(window), bool), np.zeros(len(window), np.int64)
        for k in range(width):
            inside = k < q.n[window]
            here = there(q.term[window, k], start + k)
            exact &= here | ~inside
            for d in range(1, slop + 1):
                here = here | there(q.term[window, k], start + k - d) | there(q.term[window, k], start + k + d)
            hits += here & inside
        good = hits >= q.enough[window]
        window, start, exact = window[good], start[good], exact[good]
        row = (start + (1 << PLACES - 1)) >> PLACES
        yield row, window, start - (row << PLACES), exact


def find(index: DataFrame, windows: DataFrame, width: int = WIDTH, share: float = SHARE, slop: int = SLOP, block_bytes: int = BLOCK_BYTES, chunk: int = CHUNK) -> DataFrame:
    """(uid, wid, start, n): every exact match; and, with null for start, a row per (uid, wid) for those with a proximity match.

    ``index`` and ``windows`` (wid, w) are tables of the shared folder. Rows of the first kind may be repeated.
    """
    spark = index.sparkSession
    size = windows.agg(F.sum(F.length(F.array_join("w", " ")) + 40).alias("bytes")).first().bytes or 0
    blocks = max(1, math.ceil(size / block_bytes))
    found = None
    for k in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("wid"), F.lit(blocks)) == k).collect()  # of about block_bytes
        counts = term_counts(index, sorted({t for r in rows for t in r.w}))
        shared = spark.sparkContext.broadcast(Queries.of(rows, counts, width, share))

        def run(batches, shared=shared):
            q = shared.value
            for b in batches:
                uid, base = (b.column(c).to_numpy() for c in ("uid", "base"))
                for row, window, start, exact in intersect(b.column("terms"), b.column("freqs"), b.column("positions"), q, slop, chunk):
                    pair = _distinct(row << 34 | window)
                    names = np.concatenate([uid[row[exact]], uid[pair >> 34]])
                    said = np.concatenate([window[exact], pair & ((1 << 34) - 1)])
                    begin = np.concatenate([base[row[exact]] + start[exact], np.zeros(len(pair), np.int64)])
                    mask = np.arange(len(names)) >= exact.sum()
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(q.wid[said]), pa.array(begin, mask=mask), pa.array(q.n[said], pa.int32())], ["uid", "wid", "start", "n"])

        one = index.select("uid", "base", "terms", "freqs", "positions").mapInArrow(run, "uid long, wid long, start long, n int")
        found = one if found is None else found.union(one)
    return found


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE, slop: int = SLOP) -> DataFrame:
    """uid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near, a row for each row of ``docs``.

    n_near counts the items of which a window has a proximity match (exact matches among them).
    """
    windows, of_items = windows_of(items, width)
    index = materialise(build_index(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), width + 2 * slop), "index")
    matches = materialise(find(index, windows, width, share, slop), "matches")
    exact = matches.where("start is not null")
    order = Window.partitionBy("uid").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    spans = exact.select("uid", "start", "n").distinct()
    spans = spans.withColumn("covered", F.coalesce(F.max(F.col("start") + F.col("n")).over(order), F.lit(0)))
    added = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", "covered"))
    hits = spans.groupBy("uid").agg(F.sum(added).cast("long").alias("n_hit"))
    own = matches.groupBy("uid", "wid").agg(F.max(F.col("start").isNotNull()).alias("exact")).join(of_items, "wid")
    own = own.groupBy("uid", "item_id").agg(F.max("exact").alias("exact"))
    own = own.groupBy("uid").agg(F.count("*").alias("n_near"), F.count_if("exact").alias("n_items"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item_id")))), ",").alias("ids"))
    rows = index.where("base = 0").select("uid", "doc_id", "n_words").join(own.join(hits, "uid", "left"), "uid", "left")
    zero = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", zero)
    return rows.select("uid", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", zero).alias("n_near"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without the rows in which a window of a benchmark item occurs."""
    names = docs.columns
    numbered = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    windows, _ = windows_of(items, width)
    index = materialise(build_index(numbered.select(F.col("__row").alias("uid"), F.col("__row").alias("doc_id"), "text"), width), "index")
    hit = find(index, windows, width, 1.0, 0).where("start is not null").select(F.col("uid").alias("__row")).distinct()
    return numbered.join(hit, "__row", "left_anti").select(*names)


SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase FROM starts),
lens AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT uid, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens)),
hits AS (SELECT uid, i, g.n, item_id FROM grams g JOIN windows v ON g.phrase = v.phrase AND g.n = v.n),
per_doc AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY uid),
per_item AS (SELECT uid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT uid, item_id FROM hits) GROUP BY uid),
tokens AS (SELECT uid, unnest(w) AS term, unnest(range(len(w))) AS pos FROM dw),
freqs AS (SELECT term, count(*) AS c FROM tokens GROUP BY term),
asked AS (SELECT DISTINCT phrase, n, string_split(phrase, ' ') AS v, n - (8 * n + 9) // 10 AS miss FROM windows),
spread AS (SELECT phrase, n, miss, unnest(v) AS term, unnest(range(n)) AS k FROM asked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY coalesce(c, 0), k) AS r FROM spread LEFT JOIN freqs USING (term)),
rare AS (SELECT *, least(n, miss + 2) - miss AS support FROM ranked WHERE r <= least(n, miss + 2)),
maybe AS (SELECT uid, phrase, pos - k + d AS s FROM tokens JOIN rare USING (term), (SELECT unnest([-1, 0, 1]) AS d) GROUP BY uid, phrase, s HAVING count(DISTINCT k) >= max(support)),
near AS (
  SELECT DISTINCT uid, phrase FROM maybe JOIN asked USING (phrase) JOIN dw USING (uid)
  WHERE len([k for k in range(n) if list_contains(w[greatest(s + k, 1):greatest(s + k + 2, 0)], v[k + 1])]) >= n - miss),
per_near AS (SELECT uid, count(DISTINCT item_id) AS n_near FROM near JOIN windows USING (phrase) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM dw LEFT JOIN per_doc USING (uid) LEFT JOIN per_item USING (uid) LEFT JOIN per_near USING (uid)
"""
