"""Interval merging, rejects and per-key totals against brute force, and their edge cases."""

from __future__ import annotations

import csv
import io
import random
import re
from collections import Counter, defaultdict
from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgertide.operators.dedup import copies_folded, first_written, last_written, new_rows
from ledgertide.operators.hotkeys import keys_above_share, totals_per_key
from ledgertide.operators.intervals import periods_and_gaps
from ledgertide.operators.ranking import ranked
from ledgertide.operators.rejects import split_records
from ledgertide.plans.data_queries import p3_totals

SPANS = "user string, s long, e long, k string, slab long, period long"


def merged(rows, open_end):
    """Brute force: sort and sweep."""
    by = defaultdict(list)
    for user, s, e in rows:
        e = open_end if e is None else e
        if s is not None and e >= s:
            by[user].append((s, e))
    out = set()
    for user, spans in by.items():
        spans.sort()
        periods = []
        for s, e in spans:
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out |= {("period", user, s, e) for s, e in periods}
        out |= {("gap", user, a[1], b[0]) for a, b in zip(periods, periods[1:])}
    return out


def spans(spark, rows):
    return spark.createDataFrame([(u, s, e, "x", 1, 2) for u, s, e in rows], SPANS)


def found(df):
    rows = [tuple(r) for r in df.select("kind", "user", "start_ms", "end_ms").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", range(3))
def test_intervals_match_a_sweep(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        s = rng.randrange(0, 3000)
        rows.append((rng.choice(["a", "a", "a", "b", None]), rng.choice([s, s, s, None]), rng.choice([s + rng.randrange(-20, 60)] * 9 + [None])))
    assert found(periods_and_gaps(spans(spark, rows), "user", "s", "e", 5000, slab_ms=100)) == merged(rows, 5000)


def test_intervals_edges(spark):
    run = lambda rows: found(periods_and_gaps(spans(spark, rows), "user", "s", "e", 1000, slab_ms=10))
    assert run([]) == set()
    assert run([("a", 5, 5)]) == {("period", "a", 5, 5)}
    assert run([("a", 0, 10), ("a", 10, 20)]) == {("period", "a", 0, 20)}
    assert run([("a", 0, 10), ("a", 11, 20)]) == {("period", "a", 0, 10), ("gap", "a", 10, 11), ("period", "a", 11, 20)}
    assert run([("a", 20, 10), ("a", None, 3), ("a", 2000, None)]) == set()
    assert run([("a", 0, 500), ("a", 100, 110), ("a", 490, 600)] * 3) == {("period", "a", 0, 600)}
    assert run([(None, 0, None), ("a", -30, -20)]) == {("period", None, 0, 1000), ("period", "a", -30, -20)}


# --- rejects

HEADS = {"b/20240101.csv": ["time", "user", "coin", "side", "px", "sz"], "b/20240102.csv": ["sz", "note", "side", "px", "time", "coin", "user"]}
RECORDS = "record_id long, file_name string, record_no int, record string, names string, cells string"


def strict(record: str) -> list[str] | None:
    """RFC 4180 by a state machine; None if quoting is broken."""
    out, field, i, n = [], "", 0, len(record)
    while True:
        if i < n and record[i] == '"':
            i += 1
            field = ""
            while True:
                if i >= n:
                    return None
                if record[i] == '"':
                    if i + 1 < n and record[i + 1] == '"':
                        field, i = field + '"', i + 2
                        continue
                    i += 1
                    break
                field, i = field + record[i], i + 1
            if i < n and record[i] != ",":
                return None
        else:
            start = i
            while i < n and record[i] != ",":
                if record[i] == '"':
                    return None
                i += 1
            field = record[start:i]
        out.append(field)
        if i >= n:
            return out
        i += 1


def judged(head: list[str], record: str | None) -> set[str]:
    if record is None:
        return {"column_count"}
    cells = strict(record)
    if cells is None:
        return {"quoting"}
    if len(cells) != len(head):
        return {"column_count"}
    values = {c: v.strip(" \t") for c, v in zip(head, cells)}
    bad = set()
    if not re.fullmatch("a|buy|bid|b|sell|ask", values["side"], re.I | re.A) or not values["side"].isascii():
        bad.add("side")
    for c in ("px", "sz"):
        if not re.fullmatch(r"[0-9]{1,10}(\.[0-9]{1,8})?", values[c], re.A) or not re.search("[1-9]", values[c]):
            bad.add(c)
    return bad


def raw(spark, records):
    rows = [(10_000 + i, f, 1, ",".join(h), None, None) for i, (f, h) in enumerate(HEADS.items())]
    rows += [(i, f, n, r, None, None) for i, (f, n, r) in enumerate(records)]
    return spark.createDataFrame(rows, RECORDS)


def test_rejects_match_a_state_machine(spark):
    rng = random.Random(5)
    sides = ["buy", "A", " SELL\t", "ask", "а", "asK", "", "hold", '"bid"', "b\n"]
    numbers = ["1", "0.5", "1e3", "0", "0.00000000", "-1", "1.", ".5", "12345678901", "1.123456789", '"7"', " 8 ", "١", "", "+1", "1\n"]
    texts = ["x", '"a,b"', '"say ""hi"""', 'a"b', '"open', '""', '"x"y', "\u0001", "\u0001b", '"line\nbreak"', "a,b", '"']
    records = []
    for i in range(1500):
        f = rng.choice(list(HEADS))
        values = {"side": rng.choice(sides), "px": rng.choice(numbers + ["5"] * 20), "sz": rng.choice(numbers + ["5"] * 20), "note": rng.choice(texts)}
        values |= {"time": "2024-01-01T00:00:00.123Z", "user": "0xA", "coin": rng.choice(["BTC"] * 5 + texts)}
        cells = [values[c] for c in HEADS[f]]
        if rng.random() < 0.05:
            cells = cells[:-1]
        records.append((f, i + 2, ",".join(cells)))
    records += [("b/20240101.csv", 9000, None), ("b/20240101.csv", 9001, ""), ("none/20240103.csv", 2, "a,b"), ("b/20240101.csv", None, "x")]
    valid, bad = split_records(raw(spark, records))
    expected = {(i, r) for i, (f, _, t) in enumerate(records) for r in (judged(HEADS[f], t) if f in HEADS else {"column_count"})}
    assert Counter((r.record_id, r.reason) for r in bad.collect()) == Counter(dict.fromkeys(expected, 1))
    rows = {r.record_id: r for r in valid.collect()}
    assert set(rows) == set(range(len(records))) - {i for i, _ in expected}
    for i, r in rows.items():
        values = dict(zip(HEADS[records[i][0]], strict(records[i][2])))
        assert (r.side == "buy") == (values["side"].strip(" \t").lower() in ("a", "buy", "bid"))
        assert float(r.px) == float(values["px"]) and float(r.sz) == float(values["sz"]) and r.coin == values["coin"]
        assert r.time_ms == 1704067200123 and r.builder == "b" and r.day == records[i][0][2:10]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab,"\n\u0001', max_size=6), min_size=6, max_size=6), min_size=1, max_size=8))
def test_written_records_read_back(spark, rows):
    """Whatever a CSV writer quotes is never a quoting or count reject, and comes back unchanged."""
    records = []
    for i, (note, *_rest) in enumerate(rows):
        line = io.StringIO()
        csv.writer(line, lineterminator="").writerow(["1", note, "buy", "2", "2024-01-01T00:00:00Z", note, "u"])
        records.append(("b/20240102.csv", i + 2, line.getvalue()))
    valid, bad = split_records(raw(spark, records))
    assert bad.count() == 0
    assert {r.record_id: r.coin for r in valid.collect()} == {i: row[0] for i, row in enumerate(rows)}


def test_rejects_edges(spark):
    empty = spark.createDataFrame([], RECORDS)
    valid, bad = split_records(empty)
    assert valid.count() == 0 and bad.count() == 0
    long = '"' + 'x""' * 100_000 + '"'
    df = raw(spark, [("b/20240102.csv", 2, f"1,{long},buy,2,t,c,u"), ("b/20240102.csv", 3, f"1,{long[:-1]},buy,2,t,c,u")])
    valid, bad = split_records(df.union(df))
    assert {(r.record_id, r.reason) for r in bad.collect()} == {(1, "quoting")} and bad.count() == 1
    assert [r.record_id for r in valid.collect()] == [0, 0]
    headless = spark.createDataFrame([(1, "f/x.csv", 1, "side,px", None, None), (2, "f/x.csv", 2, "buy,1", None, None)], RECORDS)
    assert [(r.record_id, r.reason) for r in split_records(headless)[1].collect()] == [(2, "sz")]
    nameless = spark.createDataFrame([(None, "b/1.csv", 1, "side,px,sz", None, None), (None, "b/1.csv", 2, "buy,1,x", None, None)], RECORDS)
    valid, bad = split_records(nameless)
    assert valid.count() == 0 and [(r.record_id, r.reason) for r in bad.collect()] == [(None, "sz")]


# --- totals and keys


def test_totals_and_shares(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["u1", "u2", None]), rng.choice(["c1", "c2"]), rng.randrange(10), "clash", "clash") for _ in range(500)]
    df = spark.createDataFrame(rows, "user string, coin string, v long, field string, key_value string")
    got = {(r.field, r.key_value): (r.n, r.total) for r in totals_per_key(df, ["user", "coin"], {"n": F.count("*"), "total": F.sum("v")}).collect()}
    want = defaultdict(lambda: [0, 0])
    for u, c, v, *_ in rows:
        for k in (("user", u), ("coin", c)):
            want[k][0] += 1
            want[k][1] += v
    assert got == {k: tuple(v) for k, v in want.items()}
    shares = {tuple(r) for r in keys_above_share(df, ["user", "coin"], 5).collect()}
    assert shares == {k for k, (n, _) in want.items() if n * 5 > 500 and k[1] is not None}
    assert totals_per_key(df.limit(0), ["user"], {"n": F.count("*")}).count() == 0
    assert keys_above_share(df.limit(0), ["user"], 5).count() == 0


def test_first_and_last_write(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 3, "only"), (None, 4, "x"), (None, 5, "y")], "k string, id int, __row string")
    assert sorted(r.id for r in first_written(df, "k", "id").collect()) == [1, 3, 4]
    assert sorted(r.id for r in last_written(df, "k", ["id"]).collect()) == [2, 3, 5]
    more = spark.createDataFrame([("a", 9, "again"), ("c", 10, "new"), ("c", 11, "copy")], df.schema)
    assert [r.id for r in new_rows(more, df, "k", "id").collect()] == [10]
    folded = copies_folded(df, "k", [], {"n": F.count("*")}, ["id"])
    assert {r.k: (r.n, r.id) for r in folded.collect()} == {"a": (2, 1), "b": (1, 3), None: (2, 4)}


def test_fills_without_a_key_are_fills_of_their_own(spark, tmp_path):
    row = lambda i, px, key: (i, "u", "c", D(px), D(2), D(1), D(-1), key)
    rows = [row(1, 5, "a"), row(2, 5, "a"), row(3, 7, None), row(4, 11, None), row(5, 11, None)]
    kinds = "id long, user string, coin string, px decimal(18,8), sz decimal(18,8), fee decimal(20,8), closed_pnl decimal(20,8), fill_key string"
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(str(tmp_path / "raw_fills.parquet"))
    got = {(r.field, r.key_value): (r["rows"], r.fills, r.volume, r.fees, r.closed_pnl) for r in p3_totals(spark, str(tmp_path)).collect()}
    assert got == {k: (5, 4, 68, 4, -4) for k in (("user", "u"), ("coin", "c"))}


def test_global_ranks(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), f"u{i}") for i in range(500)]
    got = ranked(spark.createDataFrame(rows, "v int, u string").repartition(7), [F.desc("v"), F.asc("u")]).collect()
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert {(r["rank"], r.v, r.u) for r in got} == {(i + 1, *r) for i, r in enumerate(order)}
    assert ranked(spark.createDataFrame([], "v int"), [F.desc("v")]).count() == 0
