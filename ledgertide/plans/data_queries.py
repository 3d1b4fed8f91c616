"""The general data-preparation queries over the stored tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.operators.dedup import copies_folded
from ledgertide.operators.hotkeys import keys_above_share, totals_per_key
from ledgertide.operators.intervals import periods_and_gaps
from ledgertide.operators.rejects import parsed, rejects, split_records
from ledgertide.sources.tables import table

#: What a null end of a position means: 2026-01-01T00:00:00Z.
OPEN_END_MS = 1_767_225_600_000


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects(parsed(table(spark, folder, "builder_log_records")))


def p2_valid(spark: SparkSession, folder: str) -> DataFrame:
    valid, _ = split_records(table(spark, folder, "builder_log_records"))
    return valid


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return keys_above_share(table(spark, folder, "raw_fills"), ["user", "coin"], 50)


def p3_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals over the distinct fills; ``rows`` also counts their stored copies.

    A null ``fill_key`` identifies nothing: each such row is a fill of its own, as in ``p1_percentiles``. (The
    SQL makes all of them one fill of any wallet; the tables have none.)
    """
    rows = table(spark, folder, "raw_fills").withColumn("keyless", F.when(F.col("fill_key").isNull(), F.monotonically_increasing_id()))
    fills = copies_folded(
        rows, "fill_key", ["keyless", "user", "coin"], {"rows": F.count(F.lit(1))}, ["px", "sz", "fee", "closed_pnl"]
    )
    total = lambda c, kind: F.sum(c).cast(kind)
    measures = {
        "rows": F.sum("rows"),
        "fills": F.count(F.lit(1)),
        "volume": total((F.col("px") * F.col("sz")).cast("decimal(38,16)"), "decimal(38,16)"),
        "fees": total("fee", "decimal(38,8)"),
        "closed_pnl": total("closed_pnl", "decimal(38,8)"),
    }
    return totals_per_key(fills, ["user", "coin"], measures)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return periods_and_gaps(table(spark, folder, "position_lifecycles"), "user", "start_time_ms", "end_time_ms", OPEN_END_MS)


QUERIES = {q.__name__: q for q in (p2_found, p2_valid, p3_found, p3_totals, p5_found)}

_CELLS = r"""
c AS (SELECT record_id, file_name, record_no,
             CASE WHEN regexp_full_match(record, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*')
                  THEN regexp_extract_all(record || ',', '(?s)((?:"(?:[^"]|"")*"|[^",]*)),', 1) END AS f
      FROM builder_log_records),
h AS (SELECT file_name, f AS hf FROM c WHERE record_no = 1),
p AS (SELECT record_id, file_name, f, hf FROM c JOIN h USING (file_name) WHERE record_no <> 1),
w AS (SELECT record_id, file_name, unnest(hf) AS col, unnest(f) AS v FROM p WHERE len(f) = len(hf)),
u AS (SELECT record_id, file_name, col, CASE WHEN v LIKE '"%' THEN replace(substr(v, 2, len(v) - 2), '""', '"') ELSE v END AS raw FROM w),
t AS (SELECT record_id, file_name, col, raw, trim(raw, ' ' || chr(9)) AS v FROM u),
bad AS (SELECT record_id, 'quoting' AS reason FROM p WHERE f IS NULL
        UNION ALL SELECT record_id, 'column_count' FROM p WHERE len(f) <> len(hf)
        UNION ALL SELECT record_id, col FROM t WHERE col = 'side'
            AND NOT coalesce(regexp_full_match(v, '[aA]|[bB]|[bB][uU][yY]|[bB][iI][dD]|[sS][eE][lL][lL]|[aA][sS][kK]'), false)
        UNION ALL SELECT record_id, col FROM t WHERE col IN ('px', 'sz')
            AND NOT coalesce(regexp_full_match(v, '[0-9]{1,10}([.][0-9]{1,8})?') AND regexp_matches(v, '[1-9]'), false))
"""

SQL = {
    "p2_found": f"WITH {_CELLS} SELECT DISTINCT record_id, reason FROM bad",
    "p2_valid": f"""WITH {_CELLS}
SELECT record_id, split_part(any_value(file_name), '/', 1) AS builder, regexp_extract(any_value(file_name), '([0-9]{{8}})[^/]*$', 1) AS day,
       epoch_us(any_value(TRY_CAST(v AS TIMESTAMPTZ)) FILTER (WHERE col = 'time')) // 1000 AS time_ms,
       any_value(raw) FILTER (WHERE col = 'user') AS "user", any_value(raw) FILTER (WHERE col = 'coin') AS coin,
       CASE WHEN lower(any_value(v) FILTER (WHERE col = 'side')) IN ('a', 'buy', 'bid') THEN 'buy' ELSE 'sell' END AS side,
       TRY_CAST(any_value(v) FILTER (WHERE col = 'px') AS DECIMAL(18,8)) AS px, TRY_CAST(any_value(v) FILTER (WHERE col = 'sz') AS DECIMAL(18,8)) AS sz,
       CAST(NULL AS BIGINT) AS tid, CAST(NULL AS BIGINT) AS oid
FROM (SELECT record_id, file_name, col, raw, CASE WHEN col IN ('time', 'px', 'sz', 'side') THEN v END AS v FROM t
      WHERE col IN ('time', 'user', 'coin', 'side', 'px', 'sz')) WHERE record_id NOT IN (SELECT record_id FROM bad) GROUP BY record_id""",
    "p3_found": """
SELECT 'user' AS field, "user" AS key_value FROM raw_fills WHERE "user" IS NOT NULL GROUP BY "user" HAVING count(*) * 50 > (SELECT count(*) FROM raw_fills)
UNION ALL
SELECT 'coin', coin FROM raw_fills WHERE coin IS NOT NULL GROUP BY coin HAVING count(*) * 50 > (SELECT count(*) FROM raw_fills)""",
    "p3_totals": """
WITH f AS (SELECT fill_key, any_value("user") AS u, any_value(coin) AS c, count(*) AS n, any_value(px) AS px, any_value(sz) AS sz,
                  any_value(fee) AS fee, any_value(closed_pnl) AS closed_pnl FROM raw_fills GROUP BY fill_key),
k AS (SELECT 'user' AS field, u AS key_value, * FROM f UNION ALL SELECT 'coin', c, * FROM f)
SELECT field, key_value, CAST(sum(n) AS BIGINT) AS rows, count(*) AS fills, CAST(sum(CAST(px AS DECIMAL(20,8)) * sz) AS DECIMAL(38,16)) AS volume,
       CAST(sum(fee) AS DECIMAL(38,8)) AS fees, CAST(sum(closed_pnl) AS DECIMAL(38,8)) AS closed_pnl FROM k GROUP BY 1, 2""",
    "p5_found": f"""
WITH a AS (SELECT "user", start_time_ms AS s, coalesce(end_time_ms, {OPEN_END_MS}) AS e FROM position_lifecycles),
b AS (SELECT *, max(e) OVER (PARTITION BY "user" ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM a WHERE e >= s),
c AS (SELECT *, sum(CASE WHEN reached IS NULL OR s > reached THEN 1 ELSE 0 END) OVER (PARTITION BY "user" ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT 'period' AS kind, "user", min(s) AS start_ms, max(e) AS end_ms FROM c GROUP BY "user", island
UNION ALL SELECT 'gap', "user", reached, s FROM c WHERE s > reached""",
}
