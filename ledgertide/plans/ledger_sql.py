"""The ledger queries in SQL, for comparison in another engine."""

from __future__ import annotations

from ledgertide.plans.ledger_queries import BUILDER, CAP, FROM_MS, TO_MS


def _reversed(hex_digits: str, digits: int) -> str:
    """SQL: the bytes of a hex text in reverse order."""
    return "(" + " || ".join(f"substr({hex_digits}, {i + 1}, 2)" for i in range(digits - 2, -2, -2)) + ")"


def _lifecycle_id(key: str) -> str:
    low = _reversed(f"sha256({key})", 16)
    return f"greatest(CAST(CAST('0x' || {low} AS UBIGINT) & 9223372036854775807 AS BIGINT), 1)"


def _text(d: str) -> str:
    return f"regexp_replace(CAST({d} AS VARCHAR), '[.]?0+$', '')"


def _long(v: str) -> str:
    # hex of a negative number has 16 digits already; of others leading zeros are cut
    return _reversed(f"lpad(to_hex(CAST({v} AS BIGINT)), 16, '0')", 16)


def _sized(s: str) -> str:
    length = _reversed(f"lpad(to_hex(strlen({s})), 8, '0')", 8)
    return f"{length} || hex({s})"


def _digest(parts: list[str]) -> str:
    return f"'hash:' || substr(sha256(unhex({' || '.join(parts)})), 1, 32)"


_FILL_HASH = _digest(
    [
        _sized('"user"'),
        _sized("coin"),
        _long("time_ms"),
        "CASE WHEN side = 'buy' THEN '42' ELSE '53' END",
        *[_sized(_text(c)) for c in ("px", "sz", "fee", "closed_pnl")],
        f"CASE WHEN builder_fee IS NULL THEN '00' ELSE '01' || {_sized(_text('builder_fee'))} END",
        f"CASE WHEN oid IS NULL THEN '00' ELSE '01' || {_long('oid')} END",
    ]
)
_EVENT_HASH = _digest([_sized('"user"'), _long("time_ms"), _sized(_text("amount"))])

_ORDER = 'PARTITION BY "user", coin ORDER BY time_ms, tid NULLS FIRST, oid NULLS FIRST, fill_key'
_OPENS = "CASE WHEN kind IN ('open', 'flip') THEN fill_key END"
_DAY = "strftime(make_timestamp(time_ms * 1000), '%Y%m%d')"

F_ = """f AS (SELECT id, "user", coin, time_ms, side, px, sz, fee, closed_pnl, builder_fee, tid, oid, fill_key FROM raw_fills
      QUALIFY row_number() OVER (PARTITION BY fill_key ORDER BY id) = 1)"""
M_ = f"""{F_},
s AS (SELECT *, CASE WHEN side = 'sell' THEN -sz ELSE sz END AS signed FROM f),
n AS (SELECT *, sum(signed) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS net FROM s),
k AS (SELECT *, net - signed AS prev, CASE WHEN sign(net - signed) * sign(net) < 0 THEN 'flip' WHEN net - signed = 0 AND net = 0 THEN 'none'
             WHEN net - signed = 0 THEN 'open' WHEN net = 0 THEN 'close' WHEN abs(net) > abs(net - signed) THEN 'increase' ELSE 'decrease' END AS kind FROM n),
o AS (SELECT *, last_value({_OPENS} IGNORE NULLS) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS last_opened,
             last_value({_OPENS} IGNORE NULLS) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
m AS (SELECT *, CASE WHEN kind <> 'none' THEN last_opened END AS opener, CASE WHEN kind = 'flip' THEN before END AS closer FROM o)"""
_UNITS = lambda c: f"CAST(CAST({c} AS DECIMAL(38,8)) * 100000000 AS HUGEINT)"
E_ = f"""{M_},
x AS (SELECT *, CAST(CAST({_UNITS("fee")} * {_UNITS("abs(prev)")} // {_UNITS("sz")} AS DECIMAL(28,0)) * 0.00000001 AS DECIMAL(20,8)) AS closing_fee FROM m WHERE kind = 'flip'),
e0 AS (SELECT fill_key, "user", coin, time_ms, CASE WHEN kind IN ('open', 'increase') THEN 'open' ELSE 'close' END AS effect_type, opener AS lc,
              CAST(sz AS DECIMAL(18,8)) AS qty, px, fee, closed_pnl FROM m WHERE kind NOT IN ('flip', 'none')
       UNION ALL SELECT fill_key, "user", coin, time_ms, 'close', closer, CAST(abs(prev) AS DECIMAL(18,8)), px, closing_fee, closed_pnl FROM x
       UNION ALL SELECT fill_key, "user", coin, time_ms, 'open', opener, CAST(abs(net) AS DECIMAL(18,8)), px, CAST(fee - closing_fee AS DECIMAL(20,8)), CAST(0 AS DECIMAL(20,8)) FROM x),
e AS (SELECT fill_key, "user", coin, time_ms, effect_type, {_lifecycle_id("lc")} AS lifecycle_id, qty,
             CAST(CAST(px AS DECIMAL(38,8)) * qty AS DECIMAL(38,16)) AS notional, CAST(fee AS DECIMAL(20,8)) AS fee, CAST(closed_pnl AS DECIMAL(20,8)) AS closed_pnl FROM e0)"""
A_ = """a1 AS (SELECT fill_key, attributed, mode, confidence, builder FROM fill_attributions
      QUALIFY row_number() OVER (PARTITION BY fill_key ORDER BY mode = 'logs' DESC, attributed DESC, builder DESC NULLS LAST, confidence DESC) = 1),
a AS (SELECT fill_key, coalesce(a1.attributed, coalesce(builder_fee > 0, false)) AS attributed, coalesce(a1.mode, 'heuristic') AS mode,
             coalesce(a1.confidence, 'low') AS confidence, a1.builder FROM f LEFT JOIN a1 USING (fill_key))"""
T_ = f"""{E_}, {A_},
t0 AS (SELECT e.lifecycle_id, e."user", e.coin, e.fill_key, a.attributed, a.mode FROM e LEFT JOIN a USING (fill_key)),
t AS (SELECT lifecycle_id, "user", coin, bool_or(NOT coalesce(attributed, false)) AS is_tainted,
             arg_min('Fill ' || fill_key || ' not attributed to builder (mode=' || upper(mode[1]) || mode[2:] || ')', fill_key) FILTER (WHERE NOT coalesce(attributed, false)) AS taint_reason
      FROM t0 GROUP BY ALL)"""
D_ = """d AS (SELECT event_key, min("user") AS "user", min(time_ms) AS time_ms, min(amount) AS amount, min(nullif(lower(trim(tx_hash)), '')) AS tx_hash
      FROM deposits GROUP BY event_key)"""


def _return(realized: str, capital: str) -> str:
    up = lambda c: f"CAST(CAST({c} AS DECIMAL(38,8)) * 100000000 AS HUGEINT)"
    return f"CAST(coalesce(CAST({up(realized)} * 100000000 // nullif({up(capital)}, 0) AS DECIMAL(28,0)), 0) * 0.000001 AS DECIMAL(28,6))"


def _pnl(where: str, columns: str, realized: str = "pnl", more: str = "", tail: str = "") -> str:
    return f"""WITH {T_}, {D_}{more},
w AS (SELECT e.*, coalesce(t.is_tainted, false) AS bad FROM e LEFT JOIN t USING (lifecycle_id, "user", coin) WHERE {where}),
g AS (SELECT "user", CAST(sum(closed_pnl) AS DECIMAL(38,8)) AS pnl, CAST(sum(fee) AS DECIMAL(38,8)) AS fees_paid, count(*) AS trade_count, false AS tainted,
             CAST(coalesce(sum(closed_pnl) FILTER (WHERE NOT bad), 0) AS DECIMAL(38,8)) AS clean_pnl, CAST(coalesce(sum(fee) FILTER (WHERE NOT bad), 0) AS DECIMAL(38,8)) AS clean_fees,
             count(*) FILTER (WHERE NOT bad) AS clean_count, bool_or(bad) AS any_bad FROM w GROUP BY "user"){tail}
SELECT {columns} FROM g"""


_FIRST = """,
fd AS (SELECT "user", min(time_ms) AS first_ms FROM d GROUP BY 1),
eq AS (SELECT "user", sum(v) AS equity FROM (SELECT d."user", amount AS v FROM d JOIN fd USING ("user") WHERE time_ms <= first_ms
       UNION ALL SELECT e."user", closed_pnl FROM e JOIN fd USING ("user") WHERE time_ms < first_ms) GROUP BY 1)"""
_AT = f""",
eq AS (SELECT "user", sum(v) AS equity FROM (SELECT "user", amount AS v FROM d WHERE time_ms <= {FROM_MS}
       UNION ALL SELECT "user", closed_pnl FROM e WHERE time_ms < {FROM_MS}) GROUP BY 1)"""
_WINDOW = f"time_ms BETWEEN {FROM_MS} AND {TO_MS}"


def _board(value: str, clean: bool = False, where: str = "true", kind: str = "DECIMAL(38,8)") -> str:
    kept = "NOT bad" if clean else "true"
    return f"""WITH {T_}, {D_}{_AT},
w AS (SELECT e.*, coalesce(t.is_tainted, false) AS bad FROM e LEFT JOIN t USING (lifecycle_id, "user", coin) WHERE {where}),
g AS (SELECT "user", sum(notional) FILTER (WHERE {kept}) AS volume, sum(closed_pnl) FILTER (WHERE {kept}) AS pnl, sum(fee) FILTER (WHERE {kept}) AS fees,
             count(DISTINCT fill_key) FILTER (WHERE {kept}) AS trade_count, {"bool_or(bad)" if clean else "false"} AS tainted FROM w GROUP BY "user"),
b AS (SELECT u."user", coalesce(volume, 0) AS volume, coalesce(pnl, 0) AS pnl, coalesce(fees, 0) AS fees, coalesce(trade_count, 0) AS trade_count,
             coalesce(tainted, false) AS tainted, coalesce(equity, 0) AS equity
      FROM (SELECT DISTINCT "user" FROM raw_fills) u LEFT JOIN g USING ("user") LEFT JOIN eq USING ("user")),
v AS (SELECT "user", CAST({value} AS {kind}) AS metric_value, trade_count, tainted FROM b)
SELECT row_number() OVER (ORDER BY metric_value DESC, trade_count DESC, "user") AS rank, "user", metric_value, trade_count, tainted FROM v"""


_SNAPSHOTS = f"""ss AS (SELECT "user", coin, time_ms, 0 AS seq, CAST(net AS DECIMAL(38,8)) AS net_size, opener AS lc, fill_key FROM m WHERE kind NOT IN ('flip', 'none')
       UNION ALL SELECT "user", coin, time_ms, 0, CAST(0 AS DECIMAL(38,8)), closer, fill_key FROM m WHERE kind = 'flip'
       UNION ALL SELECT "user", coin, time_ms, 1, CAST(net AS DECIMAL(38,8)), opener, fill_key FROM m WHERE kind = 'flip'),
sn AS (SELECT "user", coin, time_ms, CAST(seq AS INTEGER) AS seq, net_size, {_lifecycle_id("lc")} AS lifecycle_id, fill_key FROM ss)"""

# the average in 10^-15, folded row by row; integers, as quotients of decimals are floating-point here
_AVERAGES = f"""RECURSIVE {M_}, {_SNAPSHOTS},
y AS (SELECT fill_key, opener, kind, abs({_UNITS("prev")}) AS pu, abs({_UNITS("net")}) AS nu, {_UNITS("px")} AS xu,
             row_number() OVER (PARTITION BY "user", coin, opener ORDER BY time_ms, tid NULLS FIRST, oid NULLS FIRST, fill_key) AS i FROM m WHERE kind <> 'none'),
v AS (SELECT fill_key, opener, i, xu * 10000000 AS average FROM y WHERE i = 1
      UNION ALL SELECT y.fill_key, y.opener, y.i, CASE y.kind WHEN 'increase' THEN (pu * average + (nu - pu) * xu * 10000000) // nu WHEN 'close' THEN 0 ELSE average END
      FROM v JOIN y ON y.opener = v.opener AND y.i = v.i + 1)"""

_FUZZY = f"""l AS (SELECT lower("user") AS u, upper(coin) AS c, side, day, time_ms AS t, px, sz FROM builder_logs),
z AS (SELECT DISTINCT fill_key FROM f JOIN l ON lower(f."user") = l.u AND upper(f.coin) = l.c AND f.side = l.side AND {_DAY} = l.day
      AND abs(f.time_ms - l.t) <= 1000 AND abs(f.px - l.px) <= 0.000001 AND abs(f.sz - l.sz) <= 0.000001)"""

_TRADE = '"user", coin, time_ms, side, px, sz, fee, closed_pnl, builder_fee, tid, oid, fill_key'

SQL = {
    "fill_dedup": f"WITH {F_} SELECT * FROM f",
    "trades_ordered": f"WITH {F_} SELECT {_TRADE} FROM f",
    "trades_with_builder": f"WITH {F_}, {A_} SELECT fill_key, CASE WHEN attributed AND mode = 'logs' THEN builder END AS builder FROM f JOIN a USING (fill_key) WHERE {_WINDOW}",
    "trades_builder_only": f"""WITH {F_}, {A_}, w AS (SELECT f."user", fill_key, attributed, mode, builder, bool_or(NOT attributed) OVER (PARTITION BY f."user") AS tainted FROM f JOIN a USING (fill_key))
SELECT "user", fill_key, CASE WHEN mode = 'logs' THEN builder END AS builder, tainted FROM w WHERE attributed""",
    "trades_taint": f"""WITH {F_}, {A_} SELECT "user", bool_or(NOT attributed) AS tainted FROM f JOIN a USING (fill_key) WHERE {_WINDOW} GROUP BY "user" """,
    "fill_keys_tid": """SELECT id, "user" || ':' || coin || ':tid:' || tid AS key FROM raw_fills WHERE tid IS NOT NULL""",
    "fill_keys_hash": f"SELECT id, {_FILL_HASH} AS key FROM raw_fills",
    "event_keys": f"""SELECT key, count(*) AS n FROM (SELECT coalesce(nullif(lower(trim(tx_hash)), ''), {_EVENT_HASH}) AS key FROM deposits
UNION ALL SELECT {_EVENT_HASH} FROM deposits) GROUP BY key""",
    "distinct_coins": 'SELECT DISTINCT "user", coin FROM raw_fills',
    "day_partition": f"SELECT {_DAY} AS day, count(*) AS rows FROM raw_fills GROUP BY 1",
    "incremental_append": """SELECT min(id) AS id, fill_key FROM raw_fills WHERE time_ms >= 1704326400000
AND fill_key NOT IN (SELECT fill_key FROM raw_fills WHERE time_ms < 1704326400000) GROUP BY fill_key""",
    "position_net": f'WITH {M_} SELECT fill_key, "user", coin, CAST(prev AS DECIMAL(38,8)) AS prev, CAST(net AS DECIMAL(38,8)) AS net FROM m',
    "position_transitions": f"WITH {M_} SELECT fill_key, kind, opener, closer FROM m",
    "transition_counts": f"WITH {M_} SELECT kind, count(*) AS fills FROM m GROUP BY kind",
    "lifecycles": f"""WITH {M_},
q AS (SELECT "user", coin, opener AS lc, time_ms AS s, NULL AS e FROM m WHERE kind IN ('open', 'flip')
      UNION ALL SELECT "user", coin, coalesce(closer, opener), NULL, time_ms FROM m WHERE kind IN ('close', 'flip'))
SELECT {_lifecycle_id("lc")} AS id, "user", coin, max(s) AS start_time_ms, CAST(max(e) AS BIGINT) AS end_time_ms FROM q GROUP BY "user", coin, lc""",
    "effects_flip_split": f"WITH {E_} SELECT fill_key, effect_type, lifecycle_id, qty, notional, fee, closed_pnl FROM e",
    "snapshots_avg_entry": f"""WITH {_AVERAGES}
SELECT "user", coin, time_ms, seq, net_size, CAST(CAST((CASE WHEN net_size = 0 THEN 0 ELSE average END + 318309000) // 1000000000 AS DECIMAL(28,0)) * 0.000001 AS DECIMAL(28,6)) AS avg_entry_px,
       lifecycle_id, fill_key FROM sn JOIN v USING (fill_key)""",
    "snapshots_taint": f"""WITH {T_}, {_SNAPSHOTS} SELECT "user", bool_or(is_tainted) AS tainted FROM sn JOIN t USING (lifecycle_id, "user", coin) WHERE {_WINDOW} GROUP BY "user" """,
    "snapshots_net": f"WITH {M_}, {_SNAPSHOTS} SELECT * FROM sn WHERE {_WINDOW}",
    "snapshots_builder_only": f"""WITH {T_}, {_SNAPSHOTS} SELECT "user", coin, time_ms, seq, net_size, lifecycle_id FROM sn JOIN t USING (lifecycle_id, "user", coin) WHERE NOT is_tainted""",
    "pnl_gross": _pnl(
        'time_ms >= coalesce((SELECT first_ms FROM fd WHERE fd."user" = e."user"), 0)',
        f'"user", pnl AS realized_pnl, fees_paid, trade_count, {_return("pnl", "coalesce(equity, 0)")} AS return_pct, tainted',
        more=_FIRST,
    ).replace("FROM g", 'FROM g LEFT JOIN eq USING ("user")'),
    "pnl_net": _pnl("true", '"user", CAST(pnl - fees_paid AS DECIMAL(38,8)) AS realized_pnl, fees_paid, trade_count, tainted'),
    "pnl_all_wallets": f"""WITH {T_}, {D_}{_FIRST},
g AS (SELECT e."user", sum(closed_pnl) AS pnl, sum(fee) AS fees, count(*) AS n FROM e LEFT JOIN fd ON fd."user" = e."user"
      WHERE time_ms BETWEEN coalesce(first_ms, 0) AND {TO_MS} GROUP BY 1),
z AS (SELECT u."user", CAST(coalesce(pnl, 0) AS DECIMAL(38,8)) AS pnl, CAST(coalesce(fees, 0) AS DECIMAL(38,8)) AS fees, coalesce(n, 0) AS n, coalesce(equity, 0) AS equity
      FROM (SELECT "user" FROM raw_fills UNION SELECT "user" FROM deposits) u LEFT JOIN g USING ("user") LEFT JOIN eq USING ("user"))
SELECT "user", pnl AS realized_pnl, fees AS fees_paid, n AS trade_count, {_return("pnl", "equity")} AS return_pct, false AS tainted FROM z""",
    "pnl_with_snapshots": f"""WITH {T_}, {D_}{_FIRST},
r AS (SELECT "user", time_ms AS id, time_ms - 600000 * (ascii(sha256(event_key)) - 47) AS seen_ms, max(amount) + 1 AS reading FROM d WHERE sha256("user") >= '5' GROUP BY ALL),
rs AS (SELECT r."user", arg_max(reading, (seen_ms, id)) AS reading FROM r JOIN fd ON r."user" = fd."user" AND r.seen_ms <= first_ms GROUP BY 1),
g AS (SELECT e."user", CAST(sum(closed_pnl) AS DECIMAL(38,8)) AS pnl, CAST(sum(fee) AS DECIMAL(38,8)) AS fees, count(*) AS n FROM e LEFT JOIN fd ON fd."user" = e."user"
      WHERE time_ms >= coalesce(first_ms, 0) GROUP BY 1)
SELECT g."user", pnl AS realized_pnl, fees AS fees_paid, n AS trade_count, {_return("pnl", "coalesce(reading, equity, 0)")} AS return_pct, false AS tainted
FROM g LEFT JOIN eq USING ("user") LEFT JOIN rs USING ("user")""",
    "pnl_window": _pnl(
        _WINDOW,
        f'"user", pnl AS realized_pnl, fees_paid, trade_count, {_return("pnl", f"least(coalesce(equity, 0), {CAP})")} AS return_pct, tainted',
        more=_AT,
    ).replace("FROM g", 'FROM g LEFT JOIN eq USING ("user")'),
    "pnl_builder_only": _pnl("true", '"user", clean_pnl AS realized_pnl, clean_fees AS fees_paid, clean_count AS trade_count, any_bad AS tainted'),
    "pnl_one_coin": _pnl("e.coin = 'QRO'", '"user", pnl AS realized_pnl, fees_paid, trade_count, tainted'),
    "leaderboard_volume": _board("volume", kind="DECIMAL(38,16)"),
    "leaderboard_pnl": _board("pnl", clean=True),
    "leaderboard_return_pct": _board(_return("pnl", "equity"), where=_WINDOW, kind="DECIMAL(28,6)"),
    "leaderboard_capped": _board(_return("pnl - fees", f"least(equity, {CAP})"), where=_WINDOW, kind="DECIMAL(28,6)"),
    "attribution_heuristic": f"WITH {F_} SELECT fill_key, coalesce(builder_fee > 0, false) AS attributed, 'heuristic' AS mode, 'low' AS confidence, CAST(NULL AS VARCHAR) AS builder FROM f",
    "attribution_completed": f"WITH {F_}, {A_} SELECT * FROM a",
    "attribution_exact": f"WITH {F_} SELECT fill_key FROM f WHERE (tid, {_DAY}) IN (SELECT tid, {_DAY} FROM f WHERE tid % 4 = 0)",
    "attribution_fuzzy": f"WITH {F_}, {_FUZZY} SELECT fill_key FROM z",
    "attribution_logs": f"""WITH {F_}, {_FUZZY} SELECT fill_key, z.fill_key IS NOT NULL AS attributed, 'logs' AS mode,
CASE WHEN z.fill_key IS NULL THEN 'exact' ELSE 'fuzzy' END AS confidence, CASE WHEN z.fill_key IS NOT NULL THEN '{BUILDER}' END AS builder FROM f LEFT JOIN z USING (fill_key)""",
    "attribution_auto": f"""WITH {F_}, {_FUZZY} SELECT fill_key, z.fill_key IS NOT NULL OR coalesce(builder_fee > 0, false) AS attributed,
CASE WHEN z.fill_key IS NULL THEN 'heuristic' ELSE 'logs' END AS mode, CASE WHEN z.fill_key IS NULL THEN 'low' ELSE 'fuzzy' END AS confidence,
CASE WHEN z.fill_key IS NOT NULL THEN '{BUILDER}' END AS builder FROM f LEFT JOIN z USING (fill_key)""",
    "taint_lifecycles": f'WITH {T_} SELECT lifecycle_id, "user", coin, is_tainted FROM t',
    "taint_reason": f'WITH {T_} SELECT lifecycle_id, "user", coin, taint_reason FROM t WHERE is_tainted',
    "deposits_window": f'WITH {D_} SELECT "user", time_ms, amount, tx_hash, event_key FROM d WHERE {_WINDOW}',
    "deposits_total": f'WITH {D_} SELECT "user", CAST(sum(amount) AS DECIMAL(38,8)) AS total_deposits, count(*) AS deposit_count FROM d GROUP BY 1',
    "deposits_total_all": f"""WITH {D_} SELECT u."user", CAST(coalesce(sum(amount), 0) AS DECIMAL(38,8)) AS total_deposits, count(amount) AS deposit_count
FROM (SELECT "user" FROM raw_fills UNION SELECT "user" FROM deposits) u LEFT JOIN (SELECT * FROM d WHERE {_WINDOW}) w USING ("user") GROUP BY 1""",
    "earliest_deposit": f'WITH {D_} SELECT "user", min(time_ms) AS first_ms FROM d GROUP BY 1',
    "equity_derived": f'WITH {E_}, {D_}{_AT} SELECT "user", CAST(equity AS DECIMAL(38,8)) AS equity FROM eq',
    "equity_snapshot": f"""WITH {D_} SELECT "user", CAST(max(amount) AS DECIMAL(38,8)) AS equity FROM (SELECT *, rank() OVER (PARTITION BY "user" ORDER BY time_ms DESC) AS r
FROM d WHERE time_ms <= {TO_MS}) WHERE r = 1 GROUP BY "user" """,
    "equity_asof": f"""WITH {F_}, {D_}, r AS (SELECT "user", time_ms, max(amount) AS amount FROM d GROUP BY 1, 2)
SELECT fill_key, CAST(r.amount AS DECIMAL(38,8)) AS equity FROM f ASOF LEFT JOIN r ON f."user" = r."user" AND f.time_ms >= r.time_ms""",
    "json_fills": 'SELECT id, "user", coin, time_ms, side, px, sz, fee, closed_pnl, builder_fee, tid, oid FROM raw_fills',
    "json_deposits": f"""SELECT "user", time_ms, amount, nullif(lower(trim(tx_hash)), '') AS tx_hash, coalesce(nullif(lower(trim(tx_hash)), ''), {_EVENT_HASH}) AS event_key FROM deposits""",
    "risk_parse": f"""WITH {M_}, z AS (SELECT *, row_number() OVER (PARTITION BY "user", coin ORDER BY time_ms DESC, tid DESC NULLS LAST, oid DESC NULLS LAST, fill_key DESC) AS r FROM m)
SELECT "user", coin, CAST(net AS DECIMAL(18,8)) AS size, {_text("px")} AS entry_px, '20' AS leverage FROM z WHERE r = 1 AND net <> 0""",
}
SQL["attribution_window"] = SQL["attribution_auto"] + f" WHERE {_WINDOW}"
SQL["leaderboard_users"] = _board("pnl", where=f"e.coin = 'QRO' AND time_ms >= {FROM_MS}").replace(
    """(SELECT DISTINCT "user" FROM raw_fills) u""", """(SELECT "user" FROM raw_fills WHERE sha256("user") < '4' UNION SELECT 'nobody') u"""
)
SQL["trades_json"] = f"""WITH {F_}, {A_} SELECT '{{"timeMs":' || time_ms || ',"coin":"' || coin || '","side":"' || side || '","px":"' || {_text("px")} || '","sz":"' || {_text("sz")} || '","fee":"' || {_text("fee")}
|| '","closedPnl":"' || {_text("closed_pnl")} || '"' || CASE WHEN attributed AND mode = 'logs' AND builder IS NOT NULL THEN ',"builder":"' || builder || '"' ELSE '' END || '}}' AS body
FROM f JOIN a USING (fill_key) WHERE {_WINDOW}"""
SQL["stored_texts"] = """SELECT id, CASE WHEN id % 10 = 4 THEN 'buy' ELSE side END AS side, CASE WHEN id % 10 = 1 THEN CAST(0 AS DECIMAL(18,8)) ELSE px END AS px, sz,
CASE WHEN id % 10 = 2 THEN CAST(0 AS DECIMAL(20,8)) ELSE fee END AS fee, closed_pnl, CASE WHEN id % 10 <> 3 THEN builder_fee END AS builder_fee FROM raw_fills"""
SQL["json_fills_mixed"] = """SELECT id, "user", coin, time_ms, side, px, sz, fee, closed_pnl, CASE WHEN id % 10 <> 5 THEN builder_fee END AS builder_fee, tid, oid
FROM raw_fills WHERE id % 10 > 4"""
SQL["json_deposits_mixed"] = f"""WITH {D_}, k AS (SELECT "user", time_ms, amount, CASE WHEN time_ms % 10 = 9 THEN tx_hash END AS tx_hash FROM d WHERE time_ms % 10 IN (0, 1, 2, 3, 9))
SELECT *, coalesce(tx_hash, {_EVENT_HASH}) AS event_key FROM k"""
SQL["risk_mixed"] = f"""WITH {D_}, k AS (SELECT "user" || ' ' || event_key AS "user", amount, time_ms % 10 AS way FROM d WHERE time_ms % 10 NOT IN (0, 1)),
p AS (SELECT "user", amount, 'A' AS coin, CAST(amount AS DECIMAL(18,8)) AS size, '2.5' AS entry_px, '7' AS leverage FROM k WHERE way <> 2 AND amount <> 0
      UNION ALL SELECT "user", amount, 'A', -1, '0', '3' FROM k WHERE way <> 2
      UNION ALL SELECT "user", amount, NULL, NULL, NULL, NULL FROM k WHERE way = 2)
SELECT "user", CAST(amount AS VARCHAR) AS account_value, '9' AS withdrawable, coin, size, entry_px, leverage FROM p"""
