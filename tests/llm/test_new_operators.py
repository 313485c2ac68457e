"""Conversation repair, hard negatives and removal of repeated windows against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import negatives, repair, repeats

CONVERSATION = "conv_id long, turn long, role string, text string, note string"
LAWFUL = re.compile("(s?(ua)+)?").fullmatch


def _damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out[conv] += [(turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return out


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _cheapest(rows, faults, most_inserts=1):
    """Cost, letters and lines of the best of all ways to edit, tried one by one."""
    best = None
    extra = [[list(p) for k in range(most_inserts + 1) for p in itertools.product(("user", "assistant"), repeat=k)] for _ in range(len(rows) + 1)]
    for edits in itertools.product("DKua", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for e, f in zip(edits, faults, strict=True)):
            continue
        for gaps in itertools.product(*extra):
            cost, letters, lines = 0, "", []
            for i in range(len(rows) + 1):
                for r in gaps[i]:
                    cost, letters = cost + 5, letters + "I"
                    lines.append((r, ""))
                if i < len(rows):
                    e, (_, role, text) = edits[i], rows[i]
                    cost += {"D": 2, "K": 0}.get(e, 1) + 5 * (e != "D" and faults[i] == "truncated")
                    letters += e if e in "DK" else "R"
                    if e != "D":
                        lines.append((role if e == "K" else {"u": "user", "a": "assistant"}[e], text))
            if LAWFUL("".join(r[:1] or "?" for r, _ in lines)) and (best is None or (cost, letters) < best[:2]):
                best = cost, letters, "\n".join(f"{r}:{t}" for r, t in lines)
    return best


def _expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = _damaged(rows)[conv]
        faults = _faults(own)
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        cost, letters, body = _cheapest(own, faults)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, letters, hashlib.sha256(body.encode()).hexdigest())
    return out


def _told(spark, rows, segment=repair.SEGMENT):
    got, _ = repair.repair(spark.createDataFrame(rows, CONVERSATION), segment)
    return {r.conv_id: tuple(r)[1:] for r in got.collect()}


def test_repair_against_all_ways_of_editing(spark):
    rng = random.Random(11)
    rows = []
    for conv in [*range(12), None]:
        for turn in range(rng.randint(1, 4)):
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No!", "well", " ", None, "Why?\n"]), "x"))
    expected = _expected(rows)
    assert _told(spark, rows) == expected
    assert _told(spark, rows, 1) == expected


def test_segments_of_any_size_agree(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b.", "c", "d!", ""]) + rng.choice(["", " ", "."]), None) for c in range(3) for t in range(60 * c + 1)]
    got = [_told(spark, rows, s) for s in (128, 7, 1)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 3


def test_no_way_is_the_beginning_of_another():
    rng = random.Random(5)
    for _ in range(50):
        rows = [rng.randrange(16) for _ in range(rng.randint(1, 5))]
        ways = [("", repair.START)]
        for row in rows:
            ways = [(x + y, s) for x, p in ways for s, _, y in repair._options(p, row // 4, row % 4)]
        letters = {x for x, _ in ways}
        assert not any(a != b and b.startswith(a) for a in letters for b in letters if len(a) < 4)
        least = min((c, x) for x, s, c in _costed(rows) if s == repair.ASSISTANT) if any(s == repair.ASSISTANT for _, s, _ in _costed(rows)) else None
        width = 3 * len(rows)
        w = repair.solve_segment(rows, repair.START, width)[repair.ASSISTANT]
        assert least is None and w == repair.FORBIDDEN or (w >> 3 * width, repair._letters(w & (1 << 3 * width) - 1, width)) == least


def _costed(rows):
    ways = [("", repair.START, 0)]
    for row in rows:
        ways = [(x + y, s, c + d) for x, p, c in ways for s, d, y in repair._options(p, row // 4, row % 4)]
    return ways


def test_repair_edge_cases(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows = [(7, dropped, "user", "Gone.", None), (8, None, None, None, None)]
    none = hashlib.sha256(b"").hexdigest()
    got = _told(spark, rows)
    assert got[7] == (0, 0, 0, 0, 0, 0, "", none)
    assert got == _expected(rows)
    assert _told(spark, []) == {}
    wide = spark.createDataFrame([(1, 0, "user", "Hi.", None)], CONVERSATION).withColumns({c: F.lit(1) for c in ("key", "place", "seg", "letters", "n")})
    assert repair.repair(wide)[0].count() == 1


def test_repaired_rows_are_lawful_and_carry_texts(spark, sf_dir):
    _, rows = repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    for _, own in rows.toPandas().sort_values(["place", "sub"]).groupby("key"):
        assert LAWFUL("".join(r[0] for r in own.role))
        assert own.text[own.edit != "I"].str.strip().ne("").all() and not own.duplicated(["role", "text"])[own.edit == "K"].any()


def test_hilbert_neighbours_differ_by_one_step():
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        order = np.argsort(negatives.hilbert_keys(cells, bits))
        assert sorted(negatives.hilbert_keys(cells, bits).tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def _mined(rows):
    q, label = {}, {}
    for i, v, lab in rows:
        if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q[i], label[i] = [int(np.floor(256 * float(x))) for x in v], (lab + 1) % 10 if i % 7 == 0 else lab
    out = []
    for a in (i for i in q if i % 100 == 0):
        score = {b: sum(x * y for x, y in zip(q[a], q[b], strict=True)) for b in q if b != a and len(q[b]) == len(q[a])}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if label[b] == label[a]][:5]:
            fits = [b for b in order if label[b] != label[a] and 80 * score[p] <= 100 * score[b] <= 100 * score[p]][:5]
            out += [(a, p, r + 1, b, score[p], score[b]) for r, b in enumerate(fits)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("block, group", [(4, 1 << 20), (50, 300), (512, 64)])
def test_hard_negatives_against_brute_force(spark, block, group):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 5))
    rows = [(i, (centres[i % 6] + rng.normal(size=5) * 0.2).round(2).tolist(), int(rng.integers(0, 3))) for i in range(700)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(40)]  # equal vectors
    rows += [(2000, None, 1), (2100, [1.0, None, 0.0, 0.0, 0.0], 1), (2200, [float("nan")] * 5, 1), (2300, [1.0] * 5, None), (2400, [1.0, 2.0], 1), (2401, [1.0, 2.0], 1), (2402, [1.0, 1.9], 2), (2500, [], 0)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), block=block, group_bytes=group)
    assert sorted(map(tuple, got.collect())) == _mined(rows)


def test_zone_maps_spare_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (np.eye(8)[i % 8] * 3 + rng.normal(size=8) * 0.05).tolist(), i // 8 % 2) for i in range(4000)]
    blocks = negatives.build_blocks(negatives.prepared(spark.createDataFrame(rows, VECTORS)), block=50).collect()
    anchor = np.floor(256 * np.array(rows[0][1]))[None]
    high = [negatives.bounds(anchor, np.array(b.least), np.array(b.most))[1][0] for b in blocks]
    near = sum(h > 0.8 * 3 * 3 * 256 * 256 for h in high)
    assert near < len(blocks) / 4  # an eighth of the vectors, and blocks at the borders
    for b in blocks:
        x = np.frombuffer(b.vectors).reshape(b.rows, b.dims)
        down, up = negatives.bounds(anchor, np.array(b.least), np.array(b.most))
        assert (x @ anchor[0] <= up[0]).all() and (x @ anchor[0] >= down[0]).all() and b.rows <= 50


def test_hard_negatives_edge_cases(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    huge = [(100, [1e300, 1.0], 1), (1, [1e300, 1.0], 1), (2, [1e300, 1.0], 2), (3, [1e17, 1.0], 1)]
    assert negatives.hard_negatives(spark.createDataFrame(huge, VECTORS)).collect()[0].positive_score == (1 << 63) - 1
    clashing = spark.createDataFrame([(100, [1.0], 1), (101, [1.0], 1), (102, [0.9], 2), (None, [1.0], 2)], VECTORS).withColumns({c: F.lit(0) for c in ("uid", "block", "q", "key", "list")})
    got = [tuple(r) for r in negatives.hard_negatives(clashing).orderBy("rank").collect()]
    assert got == [(100, 101, 1, None, 65536, 65536), (100, 101, 2, 102, 65536, 256 * 230)]


def _left(texts, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


@pytest.mark.parametrize("window, gram, large", [(35, 8, 4000), (6, 2, 4000), (6, 2, 3), (4, 4, 1), (5, 1, 10)])
def test_repeats_against_brute_force(spark, window, gram, large):
    rng = random.Random(window * large)
    passage = [f"p{i}" for i in range(40)]
    texts = [None, "", " \t\x0b", "a " * 200, "é\x1cü " * 90, "one two three"]
    for _ in range(60):
        words = [rng.choice(["a", "b", "c", "dd", "é"]) for _ in range(rng.randint(0, 60))]
        at = rng.randint(0, len(words))
        if rng.random() < 0.5:
            words[at:at] = passage[rng.randint(0, 5) : rng.randint(30, 40)]
        texts.append(rng.choice([" ", "\n", " \t"]).join(words))
    texts += [texts[10]] * 12
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(df, window=window, gram=gram, large=large).collect()}
    assert [got[i] for i in range(len(texts))] == _left(texts, window)


def test_runs_share_a_minimiser_and_meet_all_windows():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    hashes[100:200] = hashes[0]  # equal words: every window has its own minimiser
    whole = repeats.minimiser_runs(hashes, 35, 8)
    repeats_block, repeats.BLOCK = repeats.BLOCK, 17
    try:
        parts = repeats.minimiser_runs(hashes, 35, 8)
    finally:
        repeats.BLOCK = repeats_block
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    starts, minis = whole
    assert starts[0] == 0 and (np.diff(starts) > 0).all() and (np.diff(starts) <= 28).all() and len(starts) == len(minis)


def test_repeats_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(none).collect() == []
    words = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, words), (1, words), (1, words), (2, "lone")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("uid", "n_words", "words", "spans", "starts")})
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(df).collect())
    assert got == [(0, 40, 40, ""), (1, 40, 40, ""), (1, 40, 40, ""), (2, 1, 0, "lone")]
