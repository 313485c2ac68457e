"""Mixing, decontamination, chat, personal data, nearest neighbours and the pipeline against SQL or brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from oracle import same
from pyspark.sql import functions as F

import corpus_pipeline
from orbweave.llm import ann, chat, decontam, mixing, pii, quality, queries, simhash
from orbweave.llm.encoding import WordEncoder
from orbweave.storage import materialise

MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    assert same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert (rows.taken <= 2 * rows["size"]).all()
    for _, own in rows.groupby("source"):
        assert abs(own.target.iloc[0] - own.taken.sum()) <= max(60, 0.01 * own.target.iloc[0])
        assert own.target.iloc[0] <= 2 * own["size"].sum() + 1e-6
    assert abs(rows.groupby("source").target.first().sum() - 1.5 * rows["size"].sum()) < 1e-3
    assert rows[rows.taken > 0].position.between(0, rows.groupby("source").target.first().sum()).all()
    assert (rows.taken == rows.positions.map(len) * rows["size"]).all()


def test_a_giant_document_does_not_shut_out_others(spark):
    counts = [1625, 408, 1000, 1625, 408, 1, 1625, 408, 1]
    rows = [(10_000 * k + i, "w " * (6 + i % 5), f"s{k}") for k, n in enumerate(counts) for i in range(n)]
    first = min(range(100_000, 110_000), key=lambda i: hashlib.md5(f"mix|{i}".encode()).hexdigest())
    # at the front of the third source, more than twice what is wanted of it
    df = spark.createDataFrame([*rows, (first, "w " * 12_000, "s2")], "doc_id long, text string, source string")
    got = mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").where("source = 's2'").toPandas()
    assert 5_000 < got.target.iloc[0] < 6_000
    assert abs(got.taken.sum() - got.target.iloc[0]) <= 10
    taken = got[got.taken > 0]
    assert taken.position.nunique() > 0.9 * len(taken)  # spread over the source's demand


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_every_source_comes_near_its_target(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    of = queries.op5_mixing(spark, f"/root/testdata/{sf}").join(docs.select("doc_id", "source"), "doc_id").groupBy("source")
    for r in of.agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.avg("size").alias("mean")).collect():
        assert abs(r.taken - r.target) <= max(0.01 * r.target, r["mean"]), r


def test_mix_runs_no_python(spark, sf_dir):
    plan = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_curriculum_inverts_its_integral(spark):
    df = spark.range(0, 3).crossJoin(spark.range(0, 101).select((F.col("id") / 100).alias("y"))).select("id", "y", mixing._when(F.col("y"), F.col("id")).alias("t"))
    for r in df.collect():
        slope = mixing.SLOPES[r.id]
        assert abs(r.t + slope * (r.t * r.t - r.t) - r.y) < 1e-9


def test_shares_of_a_stretch_of_training_follow_the_schedules(spark):
    rows = [(1000 * k + i, "w " * (5 + (i * 7 + k) % 9), f"s{k}") for k in range(6) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").toPandas()
    target = got.groupby("source").target.first()
    slope = {f"s{k}": mixing.SLOPES[k % 3] for k in range(6)}
    demand = lambda s, t: target[s] * (t + slope[s] * (t * t - t))
    due = lambda t: sum(demand(s, t) for s in target.index)
    at = got.explode("positions").dropna(subset="positions")
    for a, b in ((0.0, 0.1), (0.3, 0.5), (0.85, 1.0)):
        inside = at[(at.positions >= due(a)) & (at.positions < due(b))]
        assert abs(inside["size"].sum() / (due(b) - due(a)) - 1) < 0.02
        for s, own in inside.groupby("source"):
            assert abs(own["size"].sum() / (demand(s, b) - demand(s, a)) - 1) < 0.05


def test_targets_of_many_sources_against_plain_water_filling(spark):
    rng = random.Random(4)
    sizes = {(f"d{i:05d}" if i else None): rng.choice([0, 1, 10, 1000, 50_000]) for i in range(500)}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * n, level * weight[s]) for s, n in sizes.items()) < 1.5 * sum(sizes.values()) else (low, level)
    assert all(abs(got[s] - min(2 * n, low * weight[s])) < 1e-3 for s, n in sizes.items())


def test_mix_edge_cases(spark):
    rows = [(1, "a b c", "s"), (2, None, "s"), (3, "", None), (4, "x\u000by z", None), (4, "x\u000by z", None), (None, "w", "t")]
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, source string, size long, h string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and {r.size for r in got} == {0, 1, 3}
    assert all(r.taken == 0 for r in got if not r.size)
    assert mixing.mix(df.limit(0)).isEmpty()
    assert all(r.target == 0 for r in mixing.mix(df.where("text is null or text = ''")).collect())
    ordered = mixing.training_order(df)
    assert ordered.columns == df.columns
    assert ordered.count() == sum(len(r.positions) for r in got)
    assert mixing.training_order(df.limit(0)).isEmpty()


def test_decontamination_edge_cases(spark):
    phrase = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Start. {phrase.upper()}! end"), (1, f"Start. {phrase.upper()}! end"), (2, "one two three"), (3, None), (4, ""), (None, "tiny-item here, TINY item"), (5, f"{phrase} {phrase}"), (6, "ten nine eight seven six five four three two one eleven")]
    items = [("b", phrase), ("a", "Tiny item"), ("z", None), ("y", " ,. "), (None, "start"), ("c", phrase)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, uid long")
    i = spark.createDataFrame(items, "item_id string, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(d, i).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = [(0, 5, 4, 1, sha("a"), True), (1, 13, 11, 2, sha("b,c"), True), (1, 13, 11, 2, sha("b,c"), True), (2, 3, 0, 0, sha(""), False), (3, 0, 0, 0, sha(""), False), (4, 0, 0, 0, sha(""), False), (5, 22, 22, 2, sha("b,c"), True), (6, 11, 0, 0, sha(""), False)]
    assert got == expected
    kept = decontam.drop_contaminated(d, i)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]
    assert not decontam.contamination(d, i.limit(0)).where("contaminated").count()
    assert decontam.contamination(d.limit(0), i).isEmpty() and decontam.drop_contaminated(d.limit(0), i).isEmpty()


def _matches(texts, items, width, share, slop):
    """Exact (document, start, window) and proximity (document, window) matches by brute force."""
    exact, near = set(), set()
    cut = {tuple(w[i : i + width]) for t in items if (w := decontam.words(t)) for i in range(max(1, len(w) - width + 1))}
    for d, t in enumerate(texts):
        w = decontam.words(t)
        for v in cut:
            for s in range(-len(v), len(w) + len(v)):
                if s >= 0 and tuple(w[s : s + len(v)]) == v:
                    exact.add((d, s, b" ".join(v).decode()))
                held = sum(v[k] in w[max(0, s + k - slop) : max(0, s + k + slop + 1)] for k in range(len(v)))
                if held >= share * len(v) - 1e-9:
                    near.add((d, b" ".join(v).decode()))
    return exact, near


@pytest.mark.parametrize("slop, segment, chunk", [(0, 65_536, 400_000), (1, 7, 10), (2, 16, 50)])
def test_matches_against_brute_force(spark, monkeypatch, slop, segment, chunk):
    rng = random.Random(slop)
    items = [" ".join(rng.choice("abcdefghij") for _ in range(rng.choice([1, 2, 3, 6, 8, 9]))) for _ in range(12)] + [None, "zz yy xx ww vv uu"]
    texts = [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", "zz yy xx qq ww vv uu", "zz yy qq ww vv uu", "a " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").withColumn("doc_id", F.col("uid"))
    monkeypatch.setattr(decontam, "SEGMENT", segment)
    width, share = 6, 0.8
    windows, _ = decontam.windows_of(spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id string, text string"), width)
    index = decontam.build_index(docs, width + 2 * slop)
    phrase = {r.wid: " ".join(r.w) for r in windows.collect()}
    # few bytes a block: the windows are asked in many blocks
    rows = decontam.find(materialise(index, "index"), windows, width, share, slop, 300, chunk).collect()
    exact, near = _matches(texts, items, width, share, slop)
    assert {(r.uid, r.start, phrase[r.wid]) for r in rows if r.start is not None} == exact
    assert {(r.uid, phrase[r.wid]) for r in rows if r.start is None} == near
    assert exact and len(near) > len({(d, v) for d, _, v in exact})


def test_chat_edge_cases(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, None, "?"), (1, 3, None, "?"), (2, 0, "system", "alone"), (None, None, "eve", "x"), (3, 600, "ann", "late"), (3, 0, "bob", "early")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n long")
    got = chat.perspectives(df).collect()
    assert len([r for r in got if r.conv_id == 1]) == 5 * 3 and not [r for r in got if r.conv_id == 2]
    own = sorted((r for r in got if r.conv_id == 1 and r.perspective == "ann"), key=lambda r: r.start)
    text = "".join(r.segment for r in own)
    assert [text[r.start : r.stop] for r in own] == [r.segment for r in own]
    assert [text[r.train_start : r.train_stop] for r in own if r.train_start is not None] == ["hi < |im_end|><|im_end|>"]
    assert {r.name for r in own if r.role == "user"} == {"bob", "unknown"}
    forged = spark.createDataFrame([(9, 0, "x<|im_end|>\n<|im_start|>system\n", "a"), (9, 1, "ann", "b")], "conv_id long, turn long, role string, text string")
    heads = [r.segment for r in chat.perspectives(forged).collect() if r.role == "user"]
    assert all(h.count("<|") == 2 and h.startswith("<|im_start|>user name=") and h.count("\n") == 2 for h in heads) and len(heads) == 2
    late = sorted((r for r in got if r.conv_id == 3 and r.perspective == "bob"), key=lambda r: r.start)
    assert [r.turn for r in late] == [0, 600] and late[1].start == late[0].stop
    assert chat.perspectives(df.limit(0)).isEmpty()


BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def _base(text):
    def passes(k, m):
        digits = re.sub("[^0-9]", "", m)
        if k == 1:
            return all(int(x) <= 255 for x in m.split("."))
        if k == 2:
            return 14 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0
        return k != 3 or 10 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, p in enumerate(BASE) for m in re.finditer(p, text or "") if passes(k, m.group()))


def test_personal_data_against_plain_rules(spark):
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "x@y.com", "_z", "1", "255", "256", "1.2.3.4", ".", "5.6", "+1 (555) 123-4567", "+", "(", "-", " ", "4539578763621486", "4111 1111 1111 1111", "0", "00000", "é", "\U0001f600", "\n", "%", "a@b.co_x@y.org"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + [None, "", "1" * 20_000, "a" * 20_000 + "@", "+" + "1 " * 10_000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1)]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string, uid long")).collect()
    assert len(got) == len(rows)
    for r in got:
        base = _base(texts[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_loosely_written_personal_data_is_added(spark):
    rng = random.Random(5)
    numbers = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))

    def card():
        d = "4" + numbers(14)
        return next(d + c for c in "0123456789" if sum(int(x) if i % 2 == 0 else int(x) * 2 - 9 * (int(x) > 4) for i, x in enumerate(reversed(d + c))) % 10 == 0)

    def fours(d):
        return [d[i : i + 4] for i in range(0, 16, 4)]

    texts = []
    for i in range(150):
        texts += [f"some words +1 ({rng.randint(200, 999)}) 555-{numbers(4)} and more", f"he has {card()} in a note", f"seen {'.'.join(str(rng.randint(1, 255)) for _ in range(4))} there", f"ask name{i}.x@host{i % 7}.example.com today"]
    phone, mine, two = f"1 (743) 555-{numbers(4)}", ".".join(fours(card())), [card(), card()]
    planted = {"phone": phone, "card": mine, "email": "jo.doe (at) host3 dot org"}
    texts += [f"the words {said} and so on" for said in planted.values()]
    texts += [f"numbers {' '.join(two)} here", "1 2 " * 30 + f"555-123-{numbers(4)} end"]
    clean = ["on 2024-10-05 11 we met", "look at example.com for more", "in all 1.234.567.890 of them", "release 2.0 of 12 parts", "id 839201748392 was lost", f"token 1eb9c654e721{numbers(10)}a"]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")).collect()}
    at = 600
    for k, (kind, said) in enumerate(planted.items()):
        start = texts[at + k].index(said)
        assert f"{kind}:{start}:{start + len(said)}" == got[at + k], (texts[at + k], got[at + k])
    assert got[603] == "card:8:24,card:25:41"
    assert got[604].startswith("phone:") and got[604].endswith(":132")
    assert [got[i] for i in range(605, 605 + len(clean))] == [""] * len(clean)


def test_a_text_with_very_many_spans(spark):
    n = 50_000
    mails, numbers = "a@b.co " * n, "+1 (555) 123-4567, then " * 2_000
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame([(1, mails), (2, numbers), (3, "1 2 3 " * 5_000)], "doc_id long, text string")).collect()}
    joined = ",".join(f"email:{7 * i}:{7 * i + 6}" for i in range(n))
    assert (got[1].n_email, got[1].base_sha256, got[1].spans) == (n, hashlib.sha256(joined.encode()).hexdigest(), joined)
    assert got[2].n_phone == 2_000 and got[2].n_spans >= 2_000 and got[3].n_card == len(_base("1 2 3 " * 5_000))


def _digit_runs(text):
    """Consecutive groups of digits, from each on, tried one by one."""
    groups = [m.span() for m in re.finditer("[0-9]+", text)]
    out = []
    for i in range(len(groups)):
        for j in range(i, len(groups)):
            if any(b - a > 19 for a, b in groups[i : j + 1]) or any(not re.fullmatch("[ ().-]{1,2}", text[groups[k][1] : groups[k + 1][0]]) for k in range(i, j)) or sum(b - a for a, b in groups[i : j + 1]) > 19:
                break
            out.append((groups[i][0], groups[j][1], text[groups[i][0] : groups[j][1]]))
    return out


def test_runs_of_digits_against_plain_search(spark):
    rng = random.Random(4)
    texts = ["", "no digits", "1" * 25 + " 2 3", "12 " + "3" * 20 + ".4-5", "1 2  3   4"] + ["".join(rng.choice(["1", "22", "333", " ", "-", ". ", "  ", "x", "4" * 20, "(", ")"]) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    pieces = materialise(pii._pieces(df), "pieces")
    ids = {r.uid: r.doc_id for r in pieces.select("uid", "doc_id").collect()}
    got = sorted((ids[r.uid], r.start, r.stop, r.said) for r in pii._runs(pieces).collect())
    assert got == sorted((i, *x) for i, t in enumerate(texts) for x in _digit_runs(t))


def test_personal_data_edge_cases(spark):
    df = spark.createDataFrame([(1, "no data here")], "doc_id long, text string")
    assert pii.find_personal_data(df.limit(0)).isEmpty()
    r = pii.find_personal_data(df).first()
    assert (r.n_email, r.spans) == (0, "")
    assert pii.redact("mail a@b.c now", "email:5:10") == "mail <email> now"


def _clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 50, 32))
    return (centres[rng.integers(len(centres), size=n)] + 0.35 * rng.normal(size=(n, 32))).astype(np.float32)


@pytest.mark.parametrize("n", [300, 2_000, 12_000])
def test_nearest_neighbours_recall(spark, n):
    if n == 2_000:
        df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
        rows = df.toPandas()
        ids, x = rows.vec_id.to_numpy(), np.stack([np.array(v, np.float64) for v in rows.embedding])
    else:
        x = _clustered(n, n)
        ids = np.arange(n)
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
        x = x.astype(np.float64)
    got = ann.search(df).toPandas()
    near = got.sort_values(["query_id", "rank"]).groupby("query_id").vec_id.apply(list).to_dict()
    exact = ann.brute_force(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert set(near) == set(exact)
    assert np.mean([len(set(exact[q]) & set(near[q])) / 20 for q in exact]) >= 0.9
    product = {int(i): v for i, v in zip(ids, x, strict=True)}
    assert all(abs(r.score - product[r.query_id] @ product[r.vec_id]) < 1e-9 for r in got.itertuples())
    assert got.groupby("query_id")["rank"].apply(lambda r: sorted(r) == list(range(1, len(r) + 1))).all()


def test_large_leaves_are_cut_into_blocks(spark, monkeypatch):
    x = _clustered(400, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, ann.search(df).collect()))
    monkeypatch.setattr(ann, "CELL", 7)
    assert sorted(map(tuple, ann.search(df).collect())) == whole


def test_nearest_neighbours_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (40, []), (8, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, id int")
    got = [tuple(r) for r in ann.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert ann.search(df.limit(0)).isEmpty()


def test_many_equal_vectors(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.cos("id"), F.sin("id"))).cast("array<float>").alias("embedding"))
    got = [r.vec_id for r in ann.search(df).where("query_id = 60").orderBy("rank").collect()]
    assert got[0] == 0 and sorted(got) == got  # ties in ascending order, without the query itself
    assert 60 not in got and got == [i for i in range(0, 66, 3) if i != 60][:20]


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "token_ids"]
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in held.select("doc_id", "text").collect()}
        made = stage(spark, held, sf_dir)
        rows = [tuple(r) for r in made.collect()]
        if name != "token_ids":
            assert made.columns == docs.columns
            assert all(before[r[0]] == r[1] for r in rows)
            held = spark.createDataFrame(rows, docs.schema)
        if name in ("quality", "near_duplicates", "decontamination"):
            assert len({r[0] for r in rows}) == len(rows)
    assert len(rows) == held.count() and sum(r[2] for r in rows) == max(r[1] + r[2] for r in rows)


def test_pipeline_against_plain_code(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    weights = quality.fit(docs, labels, F.lit(True)).astype(np.float32)
    kept = {r.doc_id: r.text or "" for r in docs.collect() if 1 / (1 + np.exp(-quality.dot(r.text, weights, 18))) >= 0.7}
    prints = {i: simhash.fingerprint(t) for i, t in kept.items()}
    group = {i: i for i in prints}
    for _ in prints:  # the least id within reach, again and again
        new = {i: min(group[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2) for i in prints}
        if new == group:
            break
        group = new
    kept = {i: kept[i] for i in sorted(set(group.values()))}
    items = [decontam.words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {b" ".join(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    lengths = {len(v.split()) for v in windows}

    def clean(text):
        w = decontam.words(text)
        return not any(b" ".join(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))

    kept = {i: t for i, t in kept.items() if clean(t)}
    left = docs.where(F.col("doc_id").isin(list(kept)))
    due = mixing.mix(left).select("doc_id", F.explode("positions").alias("at")).collect()
    tokenizer = WordEncoder(public_tokenizers.path(queries.TOKENIZER)).tokenizer
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, queries.END_ID] for i, t in kept.items()}
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()), key=lambda r: r[1])
    assert Counter(r[0] for r in got) == Counter(r.doc_id for r in due) and len(got) > 50
    at, start = {}, 0
    for r in due:
        at.setdefault(r.doc_id, []).append(r["at"])
    places = [at[r[0]].pop(0) for r in got]
    assert places == sorted(places)
    for doc, begin, n, crc in got:
        assert (begin, n, crc) == (start, len(ids[doc]), zlib.crc32(np.array(ids[doc], "<u4").tobytes()))
        start += n


def test_token_files_keep_the_training_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = materialise(corpus_pipeline.mix_sources(spark, docs, sf_dir), "mixed")
    wanted = [r.doc_id for r in mixed.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    got = [r.doc_id for r in corpus_pipeline.write_token_ids(spark, mixed, sf_dir).orderBy("start").collect()]
    assert got == wanted and got != sorted(got)
    loose = spark.createDataFrame([(i, f"text {i}") for i in (5, 3, 9, 1, 7)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.write_token_ids(spark, loose, sf_dir).orderBy("start").collect()] == [5, 3, 9, 1, 7]


def test_pipeline_on_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).isEmpty()
