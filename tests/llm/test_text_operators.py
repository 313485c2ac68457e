"""Quality, toxicity, token counts, token files and SimHash against brute force, the libraries and held-out labels."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from orbweave.llm import quality, queries, simhash, tokenbin, tokencount, toxicity
from orbweave.llm.encoding import WordEncoder
from orbweave.storage import materialise, shared_path

PATH = public_tokenizers.path("word_bpe_49k.json")
MIDDLE = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word"), (None, "two words"), (5, "a b c " * 30_000), (6, "x" * 5_000), (7, "é́ ½ 한글 \U0001f600 <|endoftext|> don't")]


@pytest.fixture(scope="module")
def odd(spark):
    # extra columns, some with names that operators use
    return spark.createDataFrame([(i, t, "s", 0.5, 7) for i, t in ODD], "doc_id long, text string, source string, score double, uid long")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{MIDDLE}/labels.parquet")


def auc(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("query, label, least", [(queries.op1_quality, "quality", 0.95), (queries.op4_toxicity, "toxic", 0.85)])
def test_held_out_labels(spark, labels, query, label, least):
    rows = query(spark, MIDDLE).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(rows[label].to_numpy(), rows.score.to_numpy()) > least


def test_quality_edge_cases(spark, odd, none, labels):
    p = quality.QualityParams(train_rows=50, rounds=1)
    weights = quality.fit(odd, labels, F.lit(True), p)
    got = quality.score(odd, weights, p).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not (r.text or "").strip()}) == 1
    assert quality.score(none, weights, p).count() == 0
    untaught = quality.fit(none, labels, F.lit(True), p)
    assert not untaught.any() and quality.score(odd, untaught, p).where("predicted = 1").isEmpty()


def test_quality_training_is_plain_ftrl_whatever_the_partitions(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    p = quality.QualityParams(bits=14, rounds=2, shards=3)
    own = labels.join(docs.select("doc_id"), "doc_id")
    fits = [quality.fit(docs.repartition(n, F.rand(n)), own, F.lit(True), p) for n in (1, 2, 7)]
    assert fits[0].any() and (fits[0] == fits[1]).all() and (fits[0] == fits[2]).all()
    # the same by a plain loop on one machine
    keys = {r.doc_id: (r.shard, r.place, r.tie) for r in docs.selectExpr("doc_id", "cast(pmod(xxhash64(cast(doc_id as string), 1), 3) as int) shard", "xxhash64(cast(doc_id as string)) place", "xxhash64(doc_id, text) tie").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: int(r.quality) for r in own.collect()}
    z, n = np.zeros(2**14), np.zeros(2**14)
    for _ in range(2):
        states = []
        for shard in range(3):
            sz, sn = z.copy(), n.copy()
            for doc in sorted((d for d in known if keys[d][0] == shard), key=lambda d: keys[d][1:]):
                slots, values = quality.features(texts[doc], 14)
                score = 0.0
                for s, v in zip(slots, values, strict=True):
                    l1 = 0.0 if s == 0 else p.l1
                    w = 0.0 if abs(sz[s]) <= l1 else -(sz[s] - np.sign(sz[s]) * l1) / ((p.beta + np.sqrt(sn[s])) / p.alpha + p.l2)
                    score += w * v
                for s, v in zip(slots, values, strict=True):
                    l1 = 0.0 if s == 0 else p.l1
                    w = 0.0 if abs(sz[s]) <= l1 else -(sz[s] - np.sign(sz[s]) * l1) / ((p.beta + np.sqrt(sn[s])) / p.alpha + p.l2)
                    g = (1 / (1 + np.exp(-score)) - known[doc]) * v
                    sz[s] += g - (np.sqrt(sn[s] + g * g) - np.sqrt(sn[s])) / p.alpha * w
                    sn[s] += g * g
            states.append((sz, sn))
        z, n = sum(s[0] for s in states) / 3, sum(s[1] for s in states) / 3
    assert np.allclose(fits[0], quality._weights(z, n, p, np.arange(2**14) == 0), atol=1e-8)


def test_quality_dot_is_the_sum_over_features():
    rng = np.random.default_rng(1)
    w = rng.normal(size=2**12)
    for text in ("", "One two two THREE!! | a1 99", "x " * 500):
        slots, values = quality.features(text, 12)
        assert abs(quality.dot(text, w, 12) - w[slots] @ values) < 1e-9


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_levenshtein():
    terms = ["cat", "badger", "badgers", "elephants", "stoat"]
    automaton = toxicity.LexiconAutomaton(terms, [])
    rng = random.Random(3)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(word))
            word[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "s", "z"])
        word = "".join(word)
        allowed = [t for t in terms if _distance(word, t) <= (0 if len(t) < 5 else 1 if len(t) < 8 else 2)]
        assert automaton.look(word) == (1 if word in terms else 3 if allowed else 0), word


def test_states_are_bounded_whatever_the_words(monkeypatch):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    terms, stems = sorted({word(rng.randint(3, 9)) for _ in range(600)}), ["abc"]
    words = [w[: rng.randint(2, 9)] + word(rng.randint(0, 3)) for w in rng.choices(terms, k=4000)]
    free = toxicity.LexiconAutomaton(terms, stems)
    wanted = [free.look(w) for w in words]
    monkeypatch.setattr(toxicity, "STATES", 5_000)
    bounded, most = toxicity.LexiconAutomaton(terms, stems), 0
    got = []
    for w in words:
        got.append(bounded.look(w))
        most = max(most, bounded.held)
    assert got == wanted and free.held > 20_000 > most and set(got) > {0, 1, 3}


def test_quotation_is_not_abuse():
    automaton = toxicity.LexiconAutomaton(["badger"], ["stoa"])
    assert toxicity._hits(automaton, "you badger you bagder badgr stoaty").tolist() == [1, 1, 1, 0, 0, 0]
    assert toxicity._hits(automaton, 'they wrote "badger" yesterday').tolist() == [0, 0, 0, 1, 0, 0]
    long = "word " * (5 * toxicity.BLOCK) + "badger"
    assert toxicity._hits(automaton, long).tolist() == [1, 0, 0, 0, 0, 0]


def test_toxicity_scores_against_plain_search(spark, sf_dir, labels):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(spark.read.parquet(f"{MIDDLE}/documents.parquet"), labels, F.lit(True))
    assert model.terms and not any(s != o and s.startswith(o) for s in model.stems for o in model.stems)
    by_length = {}
    for t in model.terms:
        by_length.setdefault(len(t), []).append(t)
    memo = {}

    def kind(word):
        if word not in memo:
            near = [t for n in range(len(word) - 2, len(word) + 3) for t in by_length.get(n, []) if n >= 5 and _distance(word, t) <= (1 if n < 8 else 2)]
            memo[word] = 0 if word in model.terms else 1 if any(word.startswith(s) for s in model.stems) else 2 if near and word not in model.known else None
        return memo[word]

    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for r in docs.orderBy("doc_id").limit(60).collect():
        tokens, weight = toxicity.TOKEN.findall((r.text or "").lower()), {True: 0.0, False: 0.0}
        for i, w in enumerate(tokens):
            if kind(w) is not None:
                before, after = tokens[max(0, i - 6) : i], tokens[i + 1 : i + 7]
                quoted = bool(set(before) & toxicity.OPENING and set(after) & toxicity.CLOSING or set(before) & toxicity.REPORTING)
                weight[quoted] += (1.0, 1.0, 0.5)[kind(w)]
        x = [1.0, np.log1p(weight[False]), min(weight[False], 1.0), np.log1p(weight[True]), min(weight[True], 1.0)]
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-np.dot(x, model.weights)))) < 1e-9, r.doc_id


def test_toxicity_edge_cases(spark, odd, none, labels):
    model = toxicity.fit(none, labels, F.lit(True))
    assert toxicity.score(odd, model).where("predicted = 1").isEmpty() and toxicity.score(odd, model).count() == len(ODD)
    assert toxicity.score(none, model).isEmpty()


def test_ids_and_counts_are_the_librarys():
    encoder = WordEncoder(PATH)
    rng = random.Random(2)
    parts = ["a", "É", "é", "́", "ß", "İ", "ǅ", "Σς", "'s", "don't", "1", "½", "!", "...", "_", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "​", "漢字", "한", "하", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "<|end", "The", "word."]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        expected = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text) == encoder.pack(expected), repr(text)
        if text:
            whole = encoder.tokenizer.encode(text * 9, add_special_tokens=False).ids
            assert np.concatenate(list(tokencount.spliced(encoder.tokenizer, text * 9, 60, 40, 16))).tolist() == whole, repr(text)


def test_splicing_widens_over_one_long_word():
    tokenizer = WordEncoder(PATH).tokenizer
    text = "start " + "abcdefghij" * 200 + " end " * 50
    assert sum(map(len, tokencount.spliced(tokenizer, text, 300, 100))) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_token_counts(spark, odd, none):
    tokenizer = WordEncoder(PATH).tokenizer
    got = sorted(map(tuple, tokencount.token_counts(odd, PATH).collect()), key=repr)
    expected = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in ODD]
    assert got == sorted(expected, key=repr)
    assert tokencount.token_counts(none, PATH).isEmpty()


def test_token_files_round_trip(spark, odd, none):
    tokenizer = WordEncoder(PATH).tokenizer
    folder = shared_path(spark, "test-files")
    shape = tokenbin.write_token_files(odd, folder, PATH, 2, shards=3)
    got = [tuple(r) for r in tokenbin.read_token_files(spark, folder).orderBy("start").collect()]
    expected, start = [], 0
    for i, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    assert sum(n for _, _, n, _ in shape) == start
    empty = shared_path(spark, "test-none")
    assert tokenbin.write_token_files(none, empty, PATH, 2) == []
    assert tokenbin.read_token_files(spark, empty).isEmpty()


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = {i: _fingerprint(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == sorted(set(map(find, prints)))


def test_long_chains_in_random_order_are_one_component(spark, monkeypatch):
    rng = random.Random(11)
    chain, fp = [0], 0
    while len(chain) < 5_000:
        fp ^= (1 << rng.randrange(63)) | (1 << rng.randrange(63))
        chain.append(fp)
    chain = list(dict.fromkeys(chain))
    far = [x for x in (rng.getrandbits(63) for _ in range(50)) if min((x ^ c).bit_count() for c in chain) > 2]
    nodes = [(x,) for x in chain + far]
    rng.shuffle(nodes)
    written = []
    monkeypatch.setattr(simhash, "materialise", lambda df, label: written.append(label) or materialise(df, label))
    links = simhash.ball_links(spark.createDataFrame(nodes, "fp long"))
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    assert set(roots) == set(chain) and len(set(roots.values())) == 1
    assert written.count("merges") <= 25  # 5,000 halved about 12 times


def test_a_fingerprint_held_by_most_rows(spark):
    rows = [(i, "the same few words again" if i % 3 else f"text number {i} of its own {i * 7}") for i in range(600)]
    df = spark.createDataFrame([*rows, (None, "the same few words again")], "doc_id long, text string")
    usual, spread = ({(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicate_classes(df, hot=h).collect()} for h in (simhash.HOT, 100))
    assert usual == spread and len(usual) == 601


def test_simhash_edge_cases(spark, odd, none):
    got = simhash.near_duplicate_classes(odd).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.fp == 0} == {1}
    assert simhash.near_duplicate_classes(none).isEmpty() and simhash.keep_one(none).isEmpty()
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 1 and kept.where("doc_id is null").count() == 1
