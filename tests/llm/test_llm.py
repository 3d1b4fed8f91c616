"""The training-data operators against brute force, held-out labels and their edge cases."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from decimal import Decimal as D
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgertide.llm import mixing, subjects
from ledgertide.llm.mixing import mix, split_quotas
from ledgertide.llm.nearest import XFastTrie, nearest_in_time
from ledgertide.llm.packing import balanced, cost_of, pack, packed
from ledgertide.llm.percentiles import partial_counts, percentiles
from ledgertide.llm.tokens import counter, with_tokens

# --- percentiles


def exact(values, p):
    values = sorted(values)
    at = Fraction(str(p)) * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return Fraction(values[low]) + (Fraction(values[high]) - Fraction(values[low])) * (at - low)


def test_percentiles_match_sorting(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        group = rng.choice(["hot"] * 6 + ["a", "b", None])
        value = rng.choice([D(0), None, D(rng.randrange(-999, 999)).scaleb(-2), D(rng.randrange(10**11))])
        rows.append((i, group, value, i % 3, f"k{i}", 1, 2))
    rows += rows[:700] + [(9999, "one", D("7.5"), 0, "k-one", 1, 2)]
    rows += [(1, "hot", D(5), 1, None, 1, 2)] * 2
    df = spark.createDataFrame(rows, "id long, g string, v decimal(20,8), day int, key string, task int, upto int").repartition(5)
    probs = ["0", "0.1", "0.5", "0.9", "0.999", "1"]
    parts = [partial_counts(df.where(F.col("day") == d), "g", ["v"], "day", "key") for d in range(3)]
    got = percentiles(parts[0].unionByName(parts[1]).unionByName(parts[2]), probs).collect()
    values = defaultdict(list)
    for _, g, v, _, k, *_ in {r[4]: r for r in rows if r[4]}.values():
        if v is not None:
            values[g].append(v)
    values["hot"] += [D(5)] * 2
    assert len(got) == len(values) * len(probs)
    for r in got:
        assert r.n == len(values[r.group]) and r.field == "v"
        assert Fraction(r.value) == exact(values[r.group], r.p)


def test_percentiles_edges(spark):
    kinds = "g string, v double, day int"
    assert percentiles(partial_counts(spark.createDataFrame([], kinds), "g", ["v"], "day"), [0.5]).count() == 0
    assert percentiles(partial_counts(spark.createDataFrame([("a", None, 1)], kinds), "g", ["v"], "day"), [0.5]).count() == 0
    many = spark.createDataFrame([("a", float(i % 2), None) for i in range(1000)], kinds)
    assert [r.value for r in percentiles(partial_counts(many, "g", ["v"], "day"), [0.25, 0.75]).orderBy("p").collect()] == [0.0, 1.0]


# --- nearest in time

SIDES = "id {}, user string, coin string, side string, px decimal(18,8), sz decimal(18,8), time_ms long, g long, x int"


def brute(left, right):
    out = {}
    for a in left:
        best = None
        for b in right:
            if None in a[1:7] or None in b[0:7]:
                continue
            same = a[1].lower() == b[1].lower() and a[2].lower() == b[2].lower() and a[3] == b[3]
            if same and abs(a[4] - b[4]) <= D("0.000001") and abs(a[5] - b[5]) <= D("0.000001") and abs(a[6] - b[6]) <= 1000:
                best = min(best or (9999, 0), (abs(a[6] - b[6]), b[0]))
        if best:
            out[a[0]] = best[1]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_nearest_matches_all_pairs(spark, seed):
    rng = random.Random(seed)
    span = [300, 20_000, 2_000][seed]

    def row(i):
        return (
            i, rng.choice(["U", "u", "v", None] if seed == 0 else ["U", "u"]), rng.choice(["c", "C"]), rng.choice(["buy", "sell"]),
            rng.choice([D("1"), D("1.00000050"), D("1.00000101"), D("0.00016384"), D("0.00016383"), None]), rng.choice([D("2"), D("2.000001")]),
            rng.choice([rng.randrange(-span, span)] * 9 + [None]), 1, 2,
        )

    left, right = [row(f"f{i}") for i in range(400)], [row(i) for i in range(300)]
    a = spark.createDataFrame(left + left[:50], SIDES.format("string")).withColumnRenamed("id", "fill_key").repartition(3)
    b = spark.createDataFrame(right + right[:20] + [(None, *right[0][1:])], SIDES.format("long")).withColumnRenamed("id", "log_id").repartition(4)
    got = [tuple(r) for r in nearest_in_time(a, b, "fill_key", "log_id").collect()]
    assert len(got) == len(set(got))
    assert dict(got) == brute(left, right)


def test_nearest_edges(spark):
    kinds_a, kinds_b = SIDES.format("string"), SIDES.format("long")
    row = ("u", "c", "buy", D(1), D(1))
    a = spark.createDataFrame([("f", *row, 0, 1, 2)], kinds_a)
    b = spark.createDataFrame([(8, *row, 1000, 1, 2), (7, *row, -1000, 1, 2), (9, *row, 1001, 1, 2)], kinds_b)
    run = lambda x, y: [tuple(r) for r in nearest_in_time(x, y, "id", "id2").collect()]
    b = b.withColumnRenamed("id", "id2")
    assert run(a, b) == [("f", 7)]
    assert run(a.limit(0), b) == [] and run(a, b.limit(0)) == []
    twice = spark.createDataFrame([("f", *row, 0, 1, 2), ("f", *row, 5000, 1, 2)], kinds_a)
    assert run(twice, b) == [("f", 7)]
    hot = spark.createDataFrame([(f"f{i}", *row, i % 1500, 1, 2) for i in range(30_000)], kinds_a)
    logs = spark.createDataFrame([(i, *row, 700, 1, 2) for i in range(3000)], kinds_b).withColumnRenamed("id", "id2")
    got = run(hot, logs)
    assert len(got) == 30_000 and {r for _, r in got} == {0}


def test_nearest_over_many_batches(spark):
    """Cells that begin, go on and end in the middle of batches."""
    rng = random.Random(9)
    row = lambda i: (i, rng.choice("uv"), "c", "buy", rng.choice([D("1"), D("1.00000050")]), D(1), rng.randrange(3000), 1, 2)
    left, right = [row(f"f{i}") for i in range(300)], [row(i) for i in range(200)]
    want = brute(left, right)
    for size in (1, 7, 64):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = nearest_in_time(spark.createDataFrame(left, SIDES.format("string")).withColumnRenamed("id", "fill_key"), spark.createDataFrame(right, SIDES.format("long")).withColumnRenamed("id", "log_id"), "fill_key", "log_id").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert dict(map(tuple, got)) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 255)), max_size=40), st.lists(st.tuples(st.integers(0, 4), st.integers(0, 255)), min_size=1, max_size=40))
def test_trie_neighbours(leaves, questions):
    leaves = sorted(set(leaves))
    group, x = (np.array([v[i] for v in leaves], np.int64) for i in (0, 1))
    before, after = XFastTrie(group, x, 8).neighbours(*(np.array([q[i] for q in questions], np.int64) for i in (0, 1)))
    for (g, q), b, a in zip(questions, before, after):
        low = [i for i, (h, v) in enumerate(leaves) if h == g and v <= q]
        high = [i for i, (h, v) in enumerate(leaves) if h == g and v > q]
        assert b == (low[-1] if low else -1) and a == (high[0] if high else -1)


# --- tokens and packing


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 \n\t.,'é漢  　s"), max_size=60))
def test_word_counts_add_up(text):
    global _count, _encode
    assert _count(text) == len(_encode(text))


def setup_module():
    global _count, _encode
    import base64

    import tiktoken

    from ledgertide.llm.tokens import PATTERN, VOCABULARY

    _count = counter()
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    _encode = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.just(64))
def test_packing_is_sound(sizes, capacity):
    used = defaultdict(list)
    for (s, at), n in zip(pack(sizes, capacity), sizes, strict=True):
        used[s].append((at, n))
    for parts in used.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= capacity
    assert len(used) <= 2 * -(-sum(sizes) // capacity) + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_every_size_is_placed_by_the_rule(sizes):
    """The rule worked out by looking at every sequence for every size."""
    got, used, cost = balanced(sizes, 64), [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [s for s in range(len(used)) if used[s] + sizes[i] <= 64]
        if not fits:
            used, cost, fits = [*used, 0], [*cost, 0.0], [len(used)]
        s = min(fits, key=lambda s: (cost[s], s))
        assert got[i] == (s, used[s])
        used[s], cost[s] = used[s] + sizes[i], cost[s] + cost_of(sizes[i])


def test_the_rule_alone_wastes_little():
    rng = random.Random(7)
    sizes = [1 + int(2000 * rng.betavariate(2, 5)) for _ in range(5000)]
    costs = defaultdict(float)
    for (s, _), n in zip(balanced(sizes, 2048), sizes, strict=True):
        costs[s] += cost_of(n)
    even = sum(costs.values()) / len(costs)
    assert sum(sizes) / (2048 * len(costs)) > 0.99 and sum((c - even) ** 2 for c in costs.values()) / len(costs) < (0.1 * even) ** 2


def test_repaired_packing_holds_every_document(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    plain, tight = (packed(documents, "doc_id", "text", 2048, repair=r) for r in (False, True))
    pieces = lambda df: Counter((r.doc_id, r.piece, r.n_tokens) for r in df.collect())
    count = lambda df: df.select("sequence").distinct().count()
    assert pieces(plain) == pieces(tight) and count(tight) <= count(plain)


def test_packing_balances_costs():
    rng = random.Random(6)
    sizes = [1 + int(2000 * rng.betavariate(2, 5)) for _ in range(3000)]
    costs = defaultdict(float)
    for (s, _), n in zip(pack(sizes, 2048), sizes, strict=True):
        costs[s] += cost_of(n)
    assert len(costs) == -(-sum(sizes) // 2048)
    even = sum(costs.values()) / len(costs)
    assert sum((c - even) ** 2 for c in costs.values()) / len(costs) < 110**2


def test_packing_opens_no_more_for_the_costs():
    for seed in range(4):  # by cost alone 2, 1, 3 and 2 more than the fewest
        rng = random.Random(seed)
        sizes = [rng.randrange(100, 1001) for _ in range(3000)]
        assert len({s for s, _ in pack(sizes, 2048)}) <= -(-sum(sizes) // 2048) + 1


def test_packing_wastes_little(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    many = documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 10**6))
    rows = packed(many, "doc_id", "text", 2048).collect()
    sizes = {r.doc_id: r.n_tokens for r in with_tokens(many.select("doc_id", "text"), "text", "n_tokens").collect()}
    per_doc, per_sequence = Counter(), defaultdict(list)
    for r in rows:
        per_doc[r.doc_id] += r.n_tokens
        per_sequence[r.sequence].append((r.start, r.n_tokens, r.position))
        assert r.n_tokens == 2048 or r.piece == sizes[r.doc_id] // 2048
    assert per_doc == sizes
    for parts in per_sequence.values():
        parts.sort()
        assert [p for *_, p in parts] == list(range(len(parts))) and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[0][0] == 0
    assert sum(sizes.values()) / (2048 * len(per_sequence)) > 0.98


def test_packing_edges(spark):
    kinds = "doc_id long, text string, id long, row_id int, shard int, n_tokens int"
    rows = [(1, None, 5, 5, 5, 5), (2, "", 5, 5, 5, 5), (3, "word " * 9000, 5, 5, 5, 5), (3, "word " * 9000, 5, 5, 5, 5), (None, "a", 5, 5, 5, 5)]
    got = packed(spark.createDataFrame(rows, kinds), "doc_id", "text", 1000).collect()
    by = Counter((r.doc_id, r.sequence is None) for r in got)
    n = len(_encode("word " * 9000))
    pieces = -(-n // 1000)
    assert by == {(1, True): 1, (2, True): 1, (3, False): 2 * pieces, (None, False): 1}
    assert sum(r.n_tokens for r in got) == 2 * n + 1
    assert packed(spark.createDataFrame([], kinds), "doc_id", "text").count() == 0


# --- mixing


def corpus(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, 2) for i, s, t in rows], "doc_id long, source string, text string, block long, pass int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mix_reaches_its_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 5000)
    rng = random.Random(4)
    rows = [(i, rng.choice(["Big", "big ", "BIG", "small-one"] + ["other", None] * 1), " ".join(["word"] * rng.randrange(5, 60))) for i in range(1500)]
    rows += [(2000 + i, "tiny", "word word word word") for i in range(20)] + [(1, "big", ""), (2, "big", None)]
    want = targets(spark, [("big", 0.5, 1), ("small_one", 0.3, 3), ("tiny", 0.1, 2), ("none", 0.05, 4), ("SMALL one", 0.05, 1), (None, 0.1, 1)])
    documents = corpus(spark, rows)
    total = 30_000
    m = mix(documents, want, total_tokens=total)
    chosen, shares = m.chosen.collect(), {r.source: r for r in m.shares.collect()}
    uses = Counter((r.doc_id, r.source) for r in chosen)
    limit = {"big": 1, "small_one": 3, "tiny": 2}
    assert all(n <= limit[s] for (_, s), n in uses.items())
    assert all(sorted(r["pass"] for r in chosen if r.doc_id == d) == list(range(1, n + 1)) or n == 1 for (d, _), n in list(uses.items())[:100])
    assert abs(shares["big"].actual_share - 0.5) < 0.003 and abs(shares["small_one"].actual_share - 0.35) < 0.003
    assert shares["tiny"].chosen_tokens == 2 * shares["tiny"].available_tokens and shares["none"].chosen_tokens == 0
    assert {r.source: r.chosen_tokens for r in shares.values() if r.uses} == dict(sum((Counter({r.source: r.n_tokens}) for r in chosen), Counter()))
    by_shard = defaultdict(list)
    for r in chosen:
        by_shard[r.shard].append(r.position)
    assert len(by_shard) > 3 and all(sorted(p) == list(range(len(p))) for p in by_shard.values())
    again = mix(documents, want, total_tokens=total).chosen.collect()
    assert Counter(map(tuple, chosen)) == Counter(map(tuple, again))


def test_mix_reports_what_it_reached(spark):
    rows = [(i, "long", "word " * 9 + "word") for i in range(300)] + [(1000, "short", "word word word")]
    shares = {r.source: r for r in mix(corpus(spark, rows), targets(spark, [("long", 0.5, 1), ("short", 0.5, 2)]), total_tokens=2000).shares.collect()}
    reached = sum(r.chosen_tokens for r in shares.values())
    assert abs(reached - 1006) < 20 and {(r.mix_tokens, r.total_tokens) for r in shares.values()} == {(reached, 2000)}
    assert all(abs(r.mix_share - r.chosen_tokens / reached) < 1e-12 and abs(r.actual_share - r.chosen_tokens / 2000) < 1e-12 for r in shares.values())
    assert shares["long"].mix_share > 0.99 and abs(sum(r.mix_share for r in shares.values()) - 1) < 1e-12
    none = mix(corpus(spark, []), targets(spark, [("long", 1.0, 1)])).shares.first()
    assert (none.mix_share, none.mix_tokens, none.total_tokens) == (0, 0, 0)


def test_mix_far_larger_than_the_corpus(spark):
    """The plan has a row for each block however often it is used, and every use is in one shard."""
    rows = [(i, "a" if i % 4 else "b", " ".join(["word"] * (5 + i % 9))) for i in range(400)]
    whole = 100 * sum(len(t.split()) for *_, t in rows)
    m = mix(corpus(spark, rows), targets(spark, [("a", 0.7, 1000), ("b", 0.3, 1000)]), total_tokens=whole, block_tokens=100, shard_tokens=2000)
    chosen = m.chosen.collect()
    assert abs(sum(r.n_tokens for r in chosen) - whole) < 100
    uses = Counter((r.doc_id, r["pass"]) for r in chosen)
    assert set(uses.values()) == {1} and max(p for _, p in uses) > 100
    shards = Counter(r.shard for r in chosen)
    assert len(shards) > 100 and max(shards.values()) < 2.5 * len(chosen) / len(shards)
    spread = {r["pass"] for r in chosen if r.shard == 5}
    assert len(spread) > 5  # uses of all passes are mixed
    plans = []
    real = spark.createDataFrame
    try:
        spark.createDataFrame = lambda rows, *a, **k: plans.append(len(rows)) or real(rows, *a, **k)
        mix(m.chosen.limit(0).select(F.lit(1).alias("doc_id"), "source", F.lit("x").alias("text")).unionByName(real([(i, s, t) for i, s, t in rows], "doc_id int, source string, text string")), targets(spark, [("a", 1.0, 1000)]), total_tokens=whole, block_tokens=100)
    finally:
        spark.createDataFrame = real
    assert max(plans) < 100


def test_mix_edges(spark):
    none = mix(corpus(spark, []), targets(spark, [("a", 1.0, 1)]))
    assert none.chosen.count() == 0 and [tuple(r)[:2] for r in none.shares.collect()] == [("a", 1.0)]
    assert mix(corpus(spark, [(1, "a", "x")]), targets(spark, [])).shares.count() == 0
    odd = mix(corpus(spark, [(1, "a", "x y"), (1, "a", "x y"), (None, "A", "x y")]), targets(spark, [("a", 1.0, 2), ("b", None, None), ("c", -1.0, 0)]), total_tokens=10**6)
    assert odd.chosen.count() == 6 and {r.source: r.uses for r in odd.shares.collect()} == {"a": 6, "b": 0, "c": 0}


def test_quota_tree():
    rng = np.random.default_rng(0)
    quotas = split_quotas(np.array([1000, 10, 0, 333]), 7, rng)
    assert quotas.sum(0).tolist() == [1000, 10, 0, 333] and quotas.sum(1).max() - quotas.sum(1).min() <= 3
    first = np.array([split_quotas(np.array([40, 60]), 4, rng)[0, 0] for _ in range(2000)])
    assert abs(first.mean() - 10) < 0.3 and abs(first.var() - 25 * 0.4 * 0.6 * 75 / 99) < 0.6


# --- subjects

WORDS = {"s1": ["ball", "racket", "goal"], "s2": ["solvent", "resin", "catalyst"], "s3": ["seed", "plough", "barn"]}


def labelled(spark, n=400, seed=0):
    rng = random.Random(seed)
    docs, truth = [], []
    for i in range(n):
        mine = rng.sample(list(WORDS), rng.choice([1, 1, 2]))
        words = ["the", "of", "device", "wherein"] * 6
        for s in mine:
            words += [rng.choice(WORDS[s]) for _ in range(12)]
        words.append(rng.choice(WORDS[rng.choice(list(WORDS))]))
        rng.shuffle(words)
        docs.append((i, " ".join(words), "x", "y"))
        truth += [(i, s) for s in mine]
    areas = spark.createDataFrame([(s, s, s) for s in ["S1 ", "s2", "s3", "s4"]], "subject string, title string, scope_note string")
    return spark.createDataFrame(docs, "doc_id long, text string, id string, subject string"), truth, areas


def test_subjects_of_held_out_documents(spark):
    docs, truth, areas = labelled(spark)
    known = [(d, s.upper()) for d, s in truth if d % 3 == 0]
    labels = spark.createDataFrame(known + known[:20] + [(3, "nonsense"), (None, "s1"), (10**9, "s2")], "doc_id long, subject string")
    model = subjects.fit(docs, labels, areas)
    assert {s for s, _ in model.top_terms()} - {None} == {"s1", "s2", "s3"}
    got = {tuple(r) for r in subjects.assign(docs, model).collect()}
    want = {(d, s) for d, s in truth if d % 3}
    got = {(d, s) for d, s in got if d % 3}
    assert len(got & want) / len(got | want) > 0.97


def test_subjects_edges(spark):
    docs, truth, areas = labelled(spark, 90)
    labels = spark.createDataFrame(truth, "doc_id long, subject string")
    model = subjects.fit(docs, labels, areas)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "zzz unknown"), (4, "seed plough " * 50_000), (4, "barn barn"), (None, "ball goal")], "doc_id long, text string")
    got = Counter(tuple(r) for r in subjects.assign(odd, model).collect())
    assert got[(4, "s3")] == 2 and got[(None, "s1")] == 1 and sum(got.values()) == 6
    common = Counter(s for _, s in truth).most_common(1)[0][0]
    assert len({s for (d, s) in got if d in (1, 2, 3)}) == 1 and common in WORDS
    assert subjects.assign(docs.limit(0), model).count() == 0
    none = subjects.fit(docs, labels.limit(0), areas)
    assert subjects.assign(docs, none).count() == 90
    assert subjects.assign(docs, subjects.fit(docs, labels, areas.limit(0))).count() == 0
    assert subjects.assign(docs, subjects.fit(docs.limit(0), labels, areas)).count() == 90
