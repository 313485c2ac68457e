"""Repair of conversation structure by cheapest edits, decided by one integer minimum.

A repaired conversation's role initials read ``(s?(ua)+)?``: an optional system turn, then user and assistant in turns, or
nothing at all. Edits: Keep a row (0), Rerole it to user or assistant (1), Delete it (2; required of blank and duplicate
rows), Insert an empty user or assistant row (5); a truncated row that isn't deleted adds 5. Of all cheapest edits those
whose initials, in order, come first in ASCII are taken.

Weights: a way through the rows is one integer. Its high digits are the cost; below them stand ``3 * segment`` digits of
three bits, one for each letter (D 1, I 2, K 3, R 4) from the left, zeros behind the last. The less integer is the cheaper
way, and of equal cost the one with the lesser letters, so a plain minimum per state and row decides everything (states:
nothing yet, after system, after user, after assistant). Inserts are tied to the row behind them (two at most, as more
lead back to a state at a cost), so no way's letters are the beginning of another's over the same rows, and a minimum stays
one whatever follows.

Scale: conversations are cut into segments of ``segment`` rows, by their place in the conversation, which comes from range
partitions and prefix sums. Each segment is solved in its own task for every pair of states at its ends; a conversation's
segments are then linked in order by the same minimum, with the ways so far replaced by their rank (at most four), so the
integers never grow with the conversation. A conversation that holds most rows is many segments; one task sees of it a row
per segment, and, for the digest of the whole (which is serial by its nature), its repaired rows as a sorted stream.

Edge cases: null roles and texts are one space; a null conv_id is a conversation of its own; rows of one turn (and of null
turns, which come first) stand in the order of role and text; repeated rows are duplicates; a conversation that has lost all
rows keeps its zeros; gaps beyond 64 bits are null; empty tables give an empty result; further columns stay out.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.ranks import placed
from orbweave.storage import materialise

SEGMENT = 128
WHITE = " \t\n\x0b\x0c\r"
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5  # more, of a truncated row that is kept or reroled
LETTERS = "DIKR"
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
KINDS = "sua"  # initials; any other is the fourth kind
BLANK, DUPLICATE, CUT = 1, 2, 3
DIGIT = 3  # bits
FORBIDDEN = -1


def _after(state: int, kind: int) -> int | None:
    """The state after a row of a kind, if it may follow."""
    if kind == 0:
        return SYSTEM if state == START else None
    if kind == 1:
        return None if state == USER else USER
    return ASSISTANT if kind == 2 and state == USER else None


def _due(state: int) -> int:
    """The kind that an inserted or reroled row has: user, or assistant after user."""
    return 2 if state == USER else 1


def _inserts(state: int) -> list[tuple[int, str]]:
    """The states that up to two inserts lead to, with their letters."""
    one = _after(state, _due(state))
    two = _after(one, _due(one))
    return [(state, ""), (one, "I")] + [(two, "II")] * (two != state)


def _options(state: int, kind: int, fault: int) -> list[tuple[int, int, str]]:
    """What may be done about a row: the state after it, the cost, and the letters."""
    out = []
    for s, letters in _inserts(state):
        cost = COSTS["I"] * len(letters)
        out.append((s, cost + COSTS["D"], f"{letters}D"))
        if fault in (BLANK, DUPLICATE):
            continue
        more = TRUNCATED * (fault == CUT)
        if (kept := _after(s, kind)) is not None:
            out.append((kept, cost + COSTS["K"] + more, f"{letters}K"))
        out.append((_after(s, _due(s)), cost + COSTS["R"] + more, f"{letters}R"))
    return out


def _digits(letters: str) -> int:
    n = 0
    for x in letters:
        n = n << DIGIT | LETTERS.index(x) + 1
    return n


def _letters(digits: int, width: int) -> str:
    out = []
    for j in range(width - 1, -1, -1):
        if not (d := digits >> DIGIT * j & 7):
            break
        out.append(LETTERS[d - 1])
    return "".join(out)


#: by state and row (kind * 4 + fault): state after, cost, digits, number of letters
MOVES = [[[(s, c, _digits(x), len(x)) for s, c, x in _options(state, kind, fault)] for kind in range(4) for fault in range(4)] for state in range(4)]


def solve_segment(rows: list[int], start: int, width: int) -> list[int]:
    """Per state at the end, the least integer of all ways from ``start`` through ``rows`` (FORBIDDEN if there is none)."""
    high = DIGIT * width
    now = {start: (0, 0)}
    for row in rows:
        after: dict[int, tuple[int, int]] = {}
        for state, (weight, used) in now.items():
            for s, cost, digits, n in MOVES[state][row]:
                w = weight + (cost << high) + (digits << DIGIT * (width - used - n))
                if s not in after or w < after[s][0]:
                    after[s] = w, used + n
        now = after
    return [now[s][0] if s in now else FORBIDDEN for s in range(4)]


def link_segments(segments, width: int) -> tuple[int, list[tuple[int, str]]]:
    """The cost of the cheapest way through all segments (each a list of ``solve_segment`` per start, empty where unsolved),
    and per segment the state it starts in and its letters."""
    high = DIGIT * width
    low = (1 << high) - 1
    costs, ranks = {START: 0}, {START: 0}
    trail: list[dict[int, tuple[int, int]]] = []
    for segment in segments:
        best: dict[int, tuple[int, int, int]] = {}
        for p in costs:
            for q, w in enumerate(segment[p]):
                if w != FORBIDDEN:
                    total = (costs[p] + (w >> high) << high + 2) | ranks[p] << high | w & low
                    if q not in best or total < best[q][0]:
                        best[q] = total, p, w & low
        so_far = {q: total & (low << 2 | 3) for q, (total, _, _) in best.items()}
        order = {x: i for i, x in enumerate(sorted(set(so_far.values())))}
        costs, ranks = {q: best[q][0] >> high + 2 for q in best}, {q: order[x] for q, x in so_far.items()}
        trail.append({q: (p, digits) for q, (_, p, digits) in best.items()})
    ways = [(costs[q] + COSTS["I"] * len(x), ranks[q], x, q) for q in costs for s, x in _inserts(q) if s in ENDS]
    cost, _, last, state = min(ways)
    out = []
    for moves in reversed(trail):
        state, digits = moves[state]
        out.append((state, _letters(digits, width)))
    out.reverse()
    if out:
        out[-1] = out[-1][0], out[-1][1] + last
    return cost, out


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` (conv_id, turn, role, text) after the contract's damage, with ``key`` (never null)."""
    named = conversations.select(_key(), "turn", F.coalesce("role", F.lit(" ")).alias("r"), F.coalesce("text", F.lit(" ")).alias("t"), "conv_id")
    what = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = F.when(what == 4, "user").otherwise(F.col("r")), F.when(what == 1, "").when(what == 2, F.translate("t", ".!?", "")).otherwise(F.col("t"))
    rows = named.where(what != 0).select("key", "turn", role.alias("role"), text.alias("text"), F.struct("r", "t").alias("was"), F.when(what == 3, 2).otherwise(1).alias("times"))
    return rows.select("key", "turn", "role", "text", "was", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("key")


def in_order(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Written: ``rows`` (key, turn, role, text and, to break ties, ``was`` and ``copy``) with place and seg."""
    order = [F.asc_nulls_first("turn"), F.asc("was"), F.asc("copy")]
    out = placed(rows, order, ("key",)).drop("was", "copy")
    return materialise(out.withColumn("seg", F.floor(F.col("place") / segment).cast("long")), "turns")


def with_faults(rows: DataFrame) -> DataFrame:
    """key, place, seg, turn, fault (0, or the first of blank, duplicate, truncated) and kind of ``in_order`` rows."""
    end = F.rtrim("text", F.lit(WHITE))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    slim = rows.select("key", "place", "seg", "turn", digest.alias("digest"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"), kind.alias("kind"))
    again = slim.groupBy("key", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = slim.join(again, ["key", "digest"], "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("place") > F.col("first"), DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
    return joined.select("key", "place", "seg", "turn", fault.alias("fault"), "kind")


def _lawful(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def solved(faults: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Written: per key and seg the kinds of its rows, its illegal neighbours, and its least integers (hexadecimal, 4 by 4)."""
    width = 3 * segment
    of_segment = faults.groupBy("key", "seg").agg(F.array_sort(F.collect_list(F.struct("place", (F.col("kind") * 4 + F.col("fault")).alias("row"))))["row"].alias("rows"))

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], []]
            for seg, rows in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                kinds = [r // 4 for r in rows]
                ways = [solve_segment(rows, p, width) if seg or p == START else [FORBIDDEN] * 4 for p in range(4)]
                made = ("".join(map(str, kinds)), sum(not _lawful(x, y) for x, y in zip(kinds, kinds[1:], strict=False)), [format(w, "x") for way in ways for w in way])
                for column, v in zip(out, made, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.string()))], ["key", "seg", "kinds", "illegal", "ways"])

    return materialise(of_segment.mapInArrow(run, "key string, seg long, kinds string, illegal int, ways array<string>"), "segments")


def linked(segments: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Written: per key and seg the state it starts in and its letters; with the last one the conversation's cost and illegal."""
    width = 3 * segment
    dealt = segments.repartition("key").sortWithinPartitions("key", "seg")

    def rows_of(batches):
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def run(batches):
        out: list[tuple] = []
        for key, rows in groupby(rows_of(batches), lambda r: r[0]):
            segs: list[int] = []
            illegal, before = 0, None

            def ways(rows=rows, segs=segs):
                nonlocal illegal, before
                for _, seg, kinds, inside, found in rows:
                    illegal += inside + (before is not None and not _lawful(before, int(kinds[0])))
                    before = int(kinds[-1])
                    segs.append(seg)
                    yield [[int(x, 16) for x in found[4 * p : 4 * p + 4]] for p in range(4)]

            cost, chosen = link_segments(ways(), width)
            last = len(segs) - 1
            out += [(key, seg, state, letters, cost if i == last else None, illegal if i == last else None) for i, (seg, (state, letters)) in enumerate(zip(segs, chosen, strict=True))]
            if len(out) > 5_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "seg", "state", "letters", "cost", "illegal"])
    return materialise(dealt.mapInArrow(run, "key string, seg long, state int, letters string, cost long, illegal long"), "letters")


def edits(letters: DataFrame, segments: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row per letter: key, place (of the row; of the one an insert stands before or, at the end, behind), sub (the order of
    edits at a place), edit and the role that it gives."""
    names = {USER: "user", ASSISTANT: "assistant"}

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for key, seg, state, line, kinds in zip(*(c.to_pylist() for c in b.columns), strict=True):
                first = place = seg * segment
                last, sub = place + len(kinds) - 1, 0
                for x in line:
                    if x in "IR":
                        state = _after(state, _due(state))
                    elif x == "K":
                        state = _after(state, int(kinds[place - first]))
                    out.append((key, min(place, last), sub + 10 * (place > last), x, names.get(state) if x in "IR" else None))
                    sub += 1
                    if x != "I":
                        place, sub = place + 1, 0
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], ["key", "place", "sub", "edit", "given"])

    known = letters.select("key", "seg", "state", "letters").join(segments.select("key", "seg", "kinds"), ["key", "seg"])
    return known.mapInArrow(run, "key string, place long, sub int, edit string, given string")


def repaired_rows(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """The repaired conversations: key, place, sub, turn (null of inserts), role, text and edit."""
    kept = edited.where("edit <> 'D'").join(rows.select("key", "place", "turn", "role", "text"), ["key", "place"])
    own = lambda c, other: F.when(F.col("edit") == "I", other).otherwise(F.col(c)).alias(c)
    return kept.select("key", "place", "sub", own("turn", F.lit(None)), F.coalesce("given", "role").alias("role"), own("text", F.lit("")), "edit")


def digests(repaired: DataFrame) -> DataFrame:
    """key and the SHA-256 of its rows as ``role:text`` lines, from a sorted stream of rows."""
    dealt = repaired.select("key", "place", "sub", "role", "text").repartition("key").sortWithinPartitions("key", "place", "sub")

    def run(batches):
        of, digest = None, None
        for b in batches:
            keys, found = [], []
            for key, _, _, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if key == of:
                    digest.update(b"\n" + line)
                    continue
                if of is not None:
                    keys.append(of)
                    found.append(digest.hexdigest())
                of, digest = key, hashlib.sha256(line)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found)], ["key", "digest"])
        if of is not None:
            yield pa.RecordBatch.from_arrays([pa.array([of]), pa.array([digest.hexdigest()])], ["key", "digest"])

    return dealt.mapInArrow(run, "key string, digest string")


def repair(conversations: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Damage, faults and repair: a row per original conv_id with its figures, and the repaired rows (``repaired_rows``)."""
    rows = in_order(damaged(conversations), segment)
    faults = materialise(with_faults(rows), "faults")
    segments = solved(faults, segment)
    letters = linked(segments, segment)
    fixed = repaired_rows(rows, edits(letters, segments, segment))
    wide = lambda c: c.cast("decimal(38,0)")
    of_fault = lambda f: F.count_if(F.col("fault") == f)
    counts = faults.groupBy("key").agg((wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count_distinct("turn"))).alias("gaps"), of_fault(BLANK).alias("blank"), of_fault(DUPLICATE).alias("duplicate"), of_fault(CUT).alias("truncated"))
    audits = letters.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seg", "letters")))["letters"], "").alias("audit"), F.max("cost").alias("cost"), F.max("illegal").alias("illegal"))
    every = conversations.select("conv_id", _key()).distinct()
    out = every.join(counts, "key", "left").join(audits, "key", "left").join(digests(fixed), "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    gaps = F.when(F.col("gaps").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps").try_cast("long")).alias("gaps")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", gaps, *map(zero, ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(nothing)).alias("repaired_sha256")), fixed


SQL = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda y: ord(y)::BIGINT)) AS bytes FROM conversations),
hit AS (SELECT conv_id, turn, r, x, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS what FROM raw, tab),
dam AS (
  SELECT conv_id, turn, r, x, CASE WHEN what = 4 THEN 'user' ELSE r END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN translate(x, '.!?', '') ELSE x END AS text, unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE what <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x, copy) AS n FROM dam),
flt AS (
  SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM num),
ins(p, q, c, l, b) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
  (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:']), (3, 3, 10, 'II', ['user:', 'assistant:']), (2, 2, 10, 'II', ['assistant:', 'user:'])),
edit(q, e, i, z, c) AS (VALUES (0, 'D', NULL, 0, 2), (1, 'D', NULL, 1, 2), (2, 'D', NULL, 2, 2), (3, 'D', NULL, 3, 2), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0),
  (0, 'R', NULL, 2, 1), (1, 'R', NULL, 2, 1), (3, 'R', NULL, 2, 1), (2, 'R', NULL, 3, 1)),
way AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS body FROM (SELECT DISTINCT conv_id FROM num)
  UNION ALL
  SELECT conv_id, n, z, cost, audit, body FROM (
    SELECT w.conv_id, f.n, edit.z, w.cost + ins.c + edit.c + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost, w.audit || l || e AS audit,
      w.body || b || CASE e WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE WHEN edit.z = 2 THEN 'user:' ELSE 'assistant:' END || f.text] END AS body
    FROM way w JOIN flt f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1 JOIN ins ON ins.p = w.s JOIN edit ON edit.q = ins.q
    WHERE (e = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (e <> 'K' OR edit.i = f.i))
  QUALIFY row_number() OVER (PARTITION BY conv_id, z ORDER BY cost, audit) = 1),
sizes AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id),
fin AS (
  SELECT w.conv_id, w.cost + c AS cost, w.audit || l AS audit, w.body || b AS body FROM way w JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.n = w.n JOIN ins ON p = s AND q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + c, w.audit || l) = 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(body, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fin f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""
