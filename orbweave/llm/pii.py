"""Personal data by candidate gradient boosting. DataFrame functions and JVM models only.

*Base rules* find e-mail addresses, IPv4 addresses, card numbers (14 to 19 digits, Luhn) and phone numbers (10 to 15
digits) as leftmost non-overlapping matches per kind; matches that fail their check are dropped. Base spans always stay.

*Candidates.* High-recall generators propose further, overlapping spans: consecutive groups of digits with light
punctuation between them, from each group on, as an IP address (four groups), a card (12 to 19 digits) or a phone number
(7 to 15), however long the run of groups is; and loosely written addresses ("name (at) host dot org").

*Boosted trees* judge a candidate by format (kind, digits, groups and their lengths, punctuation, Luhn, parts up to 255,
how an address is spelled) and context (cue words and characters around it). Positives are confirmed base spans written
otherwise: without "+" or the country's number, with other separators, with "at" and "dot" spelled out. Negatives are
candidates of clearly other form that meet no base span, and confirmed spans spoilt (``_altered``: a wrong check digit, a
part above 255, a date, a bare number without a cue). A bounded sample of spans and candidates is used.

*Thresholds* are calibrated on held-out spans' examples: per kind, the lowest score from which on the share of
positives stays at ``PRECISION`` or more. A candidate at or above it that meets no base span becomes a span; of
candidates that meet each other the longest, then the likeliest, stays.

Positions are code points, end exclusive. They come from the text's pieces between matches, whose lengths are summed in
a window over a document's matches; the texts themselves are not shuffled.

Edge cases: null and empty texts have no spans; nothing is added of a kind that no base rule confirms; repeated rows are
told apart by a row number; documents without spans keep their row, with the digest of the empty string; empty tables
give an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.storage import materialise

KINDS = ("email", "ip", "card", "phone")
# the same matches as the plain patterns; possessive, and started only where a run starts, so that long runs cost no more than their length
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "group": r"[0-9]++",
    "address": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]++(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?|\x20dot\x20)[a-z0-9-]++)++",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}  # a match has this character
AROUND = 40
TRAIN_CANDIDATES = 20_000
TRAIN_SPANS = 1_500  # of each kind, each written in several ways
MOST_GROUPS = 19  # a card's digits
PRECISION = 0.98
TREES, DEPTH = 20, 4
CUES = {"ip": "ip|host|server|address|login", "card": "card|visa|credit|pay|account", "phone": "phone|tel|call|fax|mobile|sms", "email": "mail|contact|write|reach"}


def _pieces(docs: DataFrame) -> DataFrame:
    """uid, doc_id and, for each pattern, its matches and what lies between them (one piece more than matches)."""
    text = F.coalesce("text", F.lit(""))
    kept = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", text.alias("text"))
    columns = []
    for name, pattern in PATTERNS.items():
        possible = F.col("text").contains(NEEDS[name]) if name in NEEDS else F.col("text").rlike("[0-9]") if name != "address" else F.col("text").rlike(r"(?i)@|[(\[ ]at[)\] ]")
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        between = F.transform(F.split("text", pattern, -1), lambda x: F.struct(F.length(x).alias("gap"), F.right(x, F.lit(AROUND)).alias("before"), F.left(x, F.lit(AROUND)).alias("after")))
        columns += [F.when(possible, found).alias(f"m_{name}"), F.when(possible, between).alias(f"p_{name}")]
    return kept.select("uid", "doc_id", *columns)


def _spans(pieces: DataFrame, name: str) -> DataFrame:
    """uid, start, stop, said, before, after of each match of a pattern."""
    m, p = F.col(f"m_{name}"), F.col(f"p_{name}")
    has = pieces.where(F.size(m) > 0).select("uid", m.alias("m"), F.slice(p, F.lit(1), F.size(m)).alias("p"), F.slice(p, F.lit(2), F.size(m)).alias("q"))
    rows = has.select("uid", F.posexplode(F.arrays_zip("m", "p", "q")).alias("i", "x")).select("uid", "i", F.col("x.m").alias("said"), F.col("x.p.gap").alias("gap"), F.col("x.p.before").alias("before"), F.col("x.q.after").alias("after"))
    order = Window.partitionBy("uid").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.length("said")).over(order), F.lit(0)) + F.col("gap")
    return rows.select("uid", start.cast("long").alias("start"), "said", "before", "after").withColumn("stop", F.col("start") + F.length("said"))


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True for digits (a short string) whose Luhn sum is a multiple of ten."""
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    total = F.aggregate(at, F.lit(0), lambda acc, i: acc + _luhn_value(F.substring(digits, -i, F.lit(1)).cast("int"), i))
    return total % 10 == 0


def _luhn_value(d: Column, place: Column) -> Column:
    return F.when(place % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))


def _small_parts(said: Column) -> Column:
    """True if each part between dots is a number up to 255, whatever its leading zeros."""
    return F.forall(F.split(said, r"\."), lambda x: F.length(F.regexp_replace(x, "^0+", "")) <= 3) & F.forall(F.split(said, r"\."), lambda x: F.coalesce(F.right(x, F.lit(3)).try_cast("int"), F.lit(999)) <= 255)


def _passes(kind: str) -> Column:
    said, n = F.col("said"), F.length(_digits(F.col("said")))
    if kind == "ip":
        return _small_parts(said)
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(said))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(pieces: DataFrame) -> DataFrame:
    """uid, kind (its place in KINDS), start, stop, said, before, after of the spans that the base rules find."""
    found = None
    for k, kind in enumerate(KINDS):
        one = _spans(pieces, kind).where(_passes(kind)).select("uid", F.lit(k).alias("kind"), "start", "stop", "said", "before", "after")
        found = one if found is None else found.union(one)
    return found


def _runs(pieces: DataFrame) -> DataFrame:
    """uid, start, stop, said, before, after of consecutive groups of digits, up to 19 digits, from each group on.

    Groups are first told apart by the run of joined groups that they stand in, so a group that joins nothing makes one row.
    A group of more than 19 digits is no part of a run and parts its neighbours.
    """
    order = Window.partitionBy("uid").orderBy("start")
    groups = _spans(pieces, "group").withColumn("long", F.length("said") > MOST_GROUPS)
    between = F.col("start") - F.lag("stop").over(order)
    gap = F.when(between <= 2, F.right("before", between.cast("int")))
    joined = F.coalesce(gap.rlike(r"^[\x20().-]{1,2}$") & ~F.col("long") & ~F.lag("long").over(order), F.lit(False))
    groups = groups.withColumns({"gap": gap, "first": (~joined).cast("int")}).withColumn("run", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("not long")
    ahead = F.collect_list(F.struct("gap", F.col("said").alias("group"), "stop", "after")).over(Window.partitionBy("uid", "run").orderBy("start").rowsBetween(0, MOST_GROUPS - 1))
    rows = groups.select("uid", "start", "before", ahead.alias("g"))
    digits = F.transform("g", lambda x: F.length(x["group"]))
    fits = F.filter(F.sequence(F.lit(1), F.size("g")), lambda k: F.aggregate(F.slice(digits, F.lit(1), k), F.lit(0), lambda a, n: a + n) <= MOST_GROUPS)
    rows = rows.select("*", F.explode(fits).alias("k")).withColumn("g", F.slice("g", F.lit(1), F.col("k")))
    said = F.array_join(F.transform("g", lambda x, i: F.when(i == 0, x["group"]).otherwise(F.concat(x["gap"], x["group"]))), "")
    last = F.element_at("g", -1)
    return rows.select("uid", "start", last["stop"].alias("stop"), said.alias("said"), "before", last["after"].alias("after"))


def _groups(said: Column) -> Column:
    return F.filter(F.split(said, "[^0-9]+"), lambda x: x != "")


def _shaped() -> Column:
    """May ``said`` be a candidate of its kind?"""
    n = F.length(_digits(F.col("said")))
    groups = _groups(F.col("said"))
    fit = F.when(F.col("kind") == 1, (F.size(groups) == 4) & F.forall(groups, lambda g: F.length(g) <= 3))
    return fit.when(F.col("kind") == 2, n.between(12, 19)).when(F.col("kind") == 3, n.between(7, 15)).otherwise(True)


DATE = r"^(?:19|20)[0-9]{2}[-. ](?:0?[1-9]|1[0-2])[-. ][0-3]?[0-9](?![0-9])|^[0-3]?[0-9][-. ][01]?[0-9][-. ](?:19|20)[0-9]{2}(?![0-9])"
THOUSANDS = r"^[0-9]{1,3}(?:[. ][0-9]{3})+$"


def _featured(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, kind, the features of ``said`` between ``before`` and ``after``, and whether its form is clearly ``other``."""
    said, before, after = F.col("said"), F.lower("before"), F.lower("after")
    rows = rows.withColumn("g", _groups(said)).withColumn("n", F.length(_digits(said)))
    groups, n = F.col("g"), F.col("n")
    sizes = F.transform(groups, lambda g: F.length(g))
    count = lambda chars: F.length(said) - F.length(F.translate(said, chars, ""))
    cue = F.lit(0)
    for name, words in CUES.items():
        cue = F.when((F.col("kind") == KINDS.index(name)) & before.rlike(rf"(?:{words})\W{{0,3}}(?:\w{{1,8}}\W{{0,3}})?$"), 1).otherwise(cue)
    number = F.col("kind") > 0
    stuck_before, stuck_after = before.rlike(r"[\w]$"), after.rlike(r"^[\w]")
    luhn = F.when((F.col("kind") == 2) & n.between(12, 19), _luhn(_digits(said))).otherwise(False)
    parts = F.when((F.col("kind") == 1) & (count(".") == 3) & (F.size(groups) == 4), _small_parts(F.array_join(groups, "."))).otherwise(False)
    date, thousands = number & said.rlike(DATE), number & said.rlike(THOUSANDS)
    spelled_at = ~number & said.rlike(r"(?i)[a-z0-9._%+-] at [a-z0-9]")
    spelled_dot = ~number & said.rlike(r"(?i)[\x20(\[]dot[\x20)\]]")
    feats = {
        "f_kind_ip": F.col("kind") == 1, "f_kind_card": F.col("kind") == 2, "f_kind_phone": F.col("kind") == 3,
        "f_digits": F.when(number, n), "f_groups": F.when(number, F.size(groups)), "f_first": F.when(number, F.length(F.coalesce(F.get(groups, 0), F.lit("")))), "f_last": F.when(number, F.length(F.coalesce(F.try_element_at(groups, F.lit(-1)), F.lit("")))),
        "f_longest": F.when(number, F.array_max(sizes)), "f_shortest": F.when(number, F.array_min(sizes)), "f_even": number & (F.array_max(F.slice(sizes, F.lit(1), F.greatest(F.size(sizes) - 1, F.lit(1)))) == F.array_min(F.slice(sizes, F.lit(1), F.greatest(F.size(sizes) - 1, F.lit(1))))),
        "f_dots": count("."), "f_spaces": count(" "), "f_hyphens": count("-"), "f_round": count("()"), "f_length": F.when(number, F.length(said)),
        "f_luhn": luhn, "f_parts": parts, "f_date": date, "f_thousands": thousands, "f_spelled_at": spelled_at, "f_spelled_dot": spelled_dot,
        "f_cue": cue, "f_word_before": stuck_before, "f_word_after": stuck_after, "f_money": before.rlike(r"[$€£]\s?$") | after.rlike(r"^\s?(?:%|eur|usd|dollars)"),
    }
    other = F.when(F.col("kind") == 0, spelled_at & ~spelled_dot).when(F.col("kind") == 1, ~parts).when(F.col("kind") == 2, ~luhn).otherwise(date | thousands | (F.array_max(sizes) == 1))
    return rows.select(*keep, "kind", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f) for f, c in feats.items()], F.coalesce(other | (number & (stuck_before | stuck_after)), F.lit(False)).alias("other"))


def candidates(pieces: DataFrame) -> DataFrame:
    """uid, kind, start, stop, the features of each proposed span, and ``other``; groups of digits are proposed as the kinds that they may be."""
    numbers = _runs(pieces).select("*", F.explode(F.array(*[F.lit(KINDS.index(k)) for k in ("ip", "card", "phone")])).alias("kind")).where(_shaped())
    return _featured(numbers.unionByName(_spans(pieces, "address").withColumn("kind", F.lit(0))), ("uid", "start", "stop"))


def _altered(kind: str) -> list[tuple[int, Column, Column]]:
    """(label, said, before): a confirmed span written otherwise (1) or spoilt (0)."""
    said, before, digits = F.col("said"), F.col("before"), _digits(F.col("said"))
    stuck = F.concat(before, F.lit("x"))
    if kind == "email":
        name, host = F.regexp_extract(said, "^(.*)@", 1), F.regexp_extract(said, "@(.*)$", 1)
        spelled = lambda at, dot: F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot)))
        good = [spelled(*x) for x in ((" (at) ", " dot "), ("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", "."), ("(at)", "(dot)"))]
        return [(1, x, before) for x in good] + [(0, spelled(" at ", "."), before), (0, F.concat(F.lit("look at "), host), before)]
    parted = lambda text, by: F.regexp_replace(text, "[^0-9]+", by)
    if kind == "ip":
        bad = [F.regexp_replace(said, "^[0-9]+", "356"), F.regexp_replace(said, "[0-9]+$", "789"), parted(said, " ")]
        return [(1, x, before) for x in (said, parted(said, ". "), parted(said, " ."))] + [(0, x, before) for x in bad] + [(0, said, stuck)]
    if kind == "card":
        fours = lambda text, by: F.regexp_replace(text, "([0-9]{4})(?=[0-9])", "$1" + by)
        wrong = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), ((F.right(digits, F.lit(1)).cast("int") + 1) % 10).cast("string"))
        uneven = F.regexp_replace(digits, "([0-9]{3})([0-9]{5})(?=[0-9])", "$1 $2 ")
        single = lambda text: F.regexp_replace(text, "([0-9])(?=[0-9])", "$1 ")
        ragged = [single(digits), F.concat(single(F.left(digits, F.lit(6))), F.lit(" "), F.regexp_replace(F.substring(digits, F.lit(7), F.length(digits)), "([0-9]{3})(?=[0-9]{2})", "$1-"))]
        return [(1, x, before) for x in (digits, *[fours(digits, by) for by in (" ", "-", ".", "  ")])] + [(0, x, before) for x in (wrong, *[fours(wrong, by) for by in (" ", "-", ".", "  ")], uneven, *ragged)] + [(0, digits, stuck)]
    bare = F.regexp_replace(said, r"^\+", "")
    local = F.regexp_replace(bare, "^[0-9]{1,3}[^0-9]+(?=[0-9])", "")
    good = [parts for x in (bare, local) for parts in (x, parted(x, "-"), parted(x, "."), parted(x, " "))]
    day = F.concat(F.lit("20"), F.substring(digits, 2, 2), F.lit("-0"), F.substring(digits, 4, 1), F.lit("-1"), F.substring(digits, 5, 1), F.lit(" 1"), F.substring(digits, 6, 1))
    bad = [digits, F.regexp_replace(digits, "([0-9])(?=[0-9])", "$1 "), day, F.regexp_replace(digits, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", "."), F.regexp_replace(digits, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", " ")]
    marked = [(1, F.when(x != digits, x), before) for x in good]  # a number without any separator needs a cue
    return marked + [(1, digits, F.lit("phone "))] + [(0, x, F.regexp_replace(before, "[A-Za-z]+", "of")) for x in bad] + [(0, bare, stuck)]


def examples(base: DataFrame) -> DataFrame:
    """draw, kind, the features and ``label`` of a bounded sample of confirmed spans, written otherwise or spoilt."""
    made = None
    for k, kind in enumerate(KINDS):
        some = base.where((F.col("kind") == k) & (F.length("said") <= 100)).withColumn("draw", F.xxhash64("said", "start")).orderBy("draw", "said", "start", "before", "after").limit(TRAIN_SPANS)
        ways = F.array(*[F.struct(F.lit(float(y)).alias("label"), said.alias("said"), before.alias("before")) for y, said, before in _altered(kind)])
        rows = some.select("draw", "kind", "after", F.explode(ways).alias("x")).select("draw", "kind", "after", "x.*").where("said is not null")
        made = rows if made is None else made.union(rows)
    return _featured(made.where(_shaped()), ("draw", "label")).drop("other")


def _overlapping(cands: DataFrame, base: DataFrame) -> DataFrame:
    """Candidates with ``label`` (meets a base span of its kind) and ``taken`` (meets one of any kind).

    Spans of a document are sorted by start; a span meets an earlier one if the farthest end so far lies behind its
    start, and a later one if the next start lies before its end.
    """
    names = cands.columns
    marks = base.select("uid", F.col("kind").alias("k"), F.col("start").alias("s"), F.col("stop").alias("e"))
    empty = [F.lit(None).cast(cands.schema[c].dataType).alias(c) for c in names if c not in ("uid", "start")]
    rows = cands.select(*names, F.lit(1).alias("cand"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("e")).unionByName(
        marks.select("uid", F.col("s").alias("start"), *empty, F.lit(0).alias("cand"), "k", "e"))
    w = Window.partitionBy("uid").orderBy("start", "cand").rowsBetween(Window.unboundedPreceding, 0)
    # what follows, as what precedes in the order reversed: a frame up to the end would be read anew for each row
    on = Window.partitionBy("uid").orderBy(F.desc("start"), F.desc("cand")).rowsBetween(Window.unboundedPreceding, -1)
    meets = lambda here: (F.coalesce(F.max(F.when(here, F.col("e"))).over(w), F.lit(-1)) > F.col("start")) | (F.coalesce(F.min(F.when(here, F.col("start"))).over(on), F.lit(1 << 62)) < F.col("stop"))
    label = F.lit(False)
    for k in range(len(KINDS)):
        label = F.when(F.col("kind") == k, meets(F.col("k") == k)).otherwise(label)
    return rows.select(*names, "cand", label.cast("double").alias("label"), meets(F.col("k").isNotNull()).alias("taken")).where("cand = 1").drop("cand")


def fit(marked: DataFrame, base: DataFrame):
    """(a function that adds ``score`` to candidates, the least score of each kind, the scored held-out examples); None without examples.

    ``marked`` are candidates with ``label`` and ``taken``; examples of one draw stay on one side of the split.
    """
    feats = [c for c in marked.columns if c.startswith("f_")]
    # drawn by what the trees see, so that the model depends neither on files nor on the order of rows
    drawn = marked.where("label = 0 and not taken and other").withColumn("draw", F.xxhash64("start", "kind", *feats))
    negatives = drawn.orderBy("draw", "start", "kind", *feats).limit(TRAIN_CANDIDATES).select("draw", "label", "kind", *feats)
    sample = negatives.unionByName(examples(base).select("draw", "label", "kind", *feats))
    sample = materialise(sample.withColumn("held", F.pmod(F.xxhash64("draw"), F.lit(4)) == 0), "pii-sample")
    if sample.where("not held").select("label").distinct().count() < 2:
        return None
    assembled = lambda df: VectorAssembler(inputCols=feats, outputCol="features").transform(df)
    train = assembled(sample.where("not held").repartition(4, "draw").sortWithinPartitions("draw", "kind", "label", *feats))
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=11, checkpointInterval=-1).fit(train)
    chance = lambda df: model.transform(assembled(df)).withColumn("score", vector_to_array("probability")[1])
    held = chance(sample.where("held"))
    # calibration: per kind and bin of scores, the share of positives from there on
    bins = held.groupBy("kind", F.floor(F.col("score") * 50).alias("bin")).agg(F.sum("label").alias("yes"), F.count("*").alias("n")).collect()
    limit = {}
    for k in range(len(KINDS)):
        yes = n = 0
        for b in sorted((b for b in bins if b.kind == k), key=lambda b: -b.bin):
            yes, n = yes + b.yes, n + b.n
            if yes / n < PRECISION:
                break
            limit[k] = max(b.bin / 50, 0.5)
    return chance, limit, held


def added_spans(cands: DataFrame, base: DataFrame) -> DataFrame:
    """uid, kind, start, stop of the candidates that the boosted trees add to the base."""
    marked = materialise(_overlapping(cands, base), "candidates")
    learnt = fit(marked, base)
    if learnt is None or not learnt[1]:
        return marked.select("uid", "kind", "start", "stop").limit(0)
    chance, limit, _ = learnt
    scored = chance(marked.where(~F.col("taken") & F.col("kind").isin(list(limit))))
    least = F.lit(2.0)
    for k, v in limit.items():
        least = F.when(F.col("kind") == k, v).otherwise(least)
    good = scored.where(F.col("score") >= least)
    return _apart(good.select("uid", "kind", "start", "stop", "score"))


def _apart(good: DataFrame) -> DataFrame:
    """uid, kind, start, stop: of spans that meet each other the longest, then the likeliest, of each document."""
    order = Window.partitionBy("uid").orderBy("start", "stop", "kind")
    first = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) <= F.col("start")
    clusters = good.withColumn("first", first.cast("int")).withColumn("cluster", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct((F.col("start") - F.col("stop")).alias("short"), (-F.col("score")).alias("rank"), "start", "stop", "kind")
    listed = clusters.groupBy("uid", "cluster").agg(F.sort_array(F.collect_list(one)).alias("all"))
    none = F.slice("all", F.lit(1), F.lit(0))
    kept = F.aggregate("all", none, lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"])), acc).otherwise(F.concat(acc, F.array(x))))
    return listed.select("uid", F.explode(kept).alias("x")).select("uid", "x.kind", "x.start", "x.stop")


def _joined(spans: DataFrame, name: str) -> DataFrame:
    said = F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), F.col("start").cast("string"), F.col("stop").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct("start", "kind", "stop", said.alias("said"))))
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"{name}_{kind}") for k, kind in enumerate(KINDS)]
    return spans.groupBy("uid").agg(F.array_join(listed["said"], ",").alias(name), *counts)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_spans (base and added) of each row of ``docs``."""
    pieces = materialise(_pieces(docs), "pieces")
    base = materialise(base_spans(pieces), "base-spans")
    added = added_spans(candidates(pieces), base)
    base = base.select("uid", "kind", "start", "stop")
    everything = _joined(base.union(added.select("uid", "kind", "start", "stop")), "spans")
    everything = everything.select("uid", "spans", sum(F.col(f"spans_{kind}") for kind in KINDS).alias("n_spans"))
    rows = pieces.select("uid", "doc_id").join(_joined(base, "base"), "uid", "left").join(everything, "uid", "left")
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(f"base_{kind}", zero).alias(f"n_{kind}") for kind in KINDS]
    return rows.select("doc_id", *counts, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_spans", zero).alias("n_spans"))


def redact(text: str, spans: str) -> str:
    """A text with its spans (as in the column ``spans``) replaced by their kinds, for display and tests."""
    out, last = [], 0
    for kind, start, stop in (x.split(":") for x in spans.split(",") if x):
        if int(start) >= last:
            out += [text[last : int(start)], f"<{kind}>"]
        last = max(last, int(stop))
    return "".join(out) + text[last:]
