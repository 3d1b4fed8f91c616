"""The queries of this subpackage over the stored tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.mixing import Mix, mix
from ledgertide.llm.nearest import nearest_in_time
from ledgertide.llm.packing import packed
from ledgertide.llm.percentiles import partial_counts, percentiles
from ledgertide.llm.subjects import assign, fit
from ledgertide.operators.storage import small_or_shuffled
from ledgertide.sources.tables import table

PERCENTILES = ["0.01", "0.1", "0.25", "0.5", "0.75", "0.9", "0.99"]
MIN_FILLS, COUNTED = 200, "fills"
MAX_BROADCAST_COINS = 50_000


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    """Partial counts of fee and closed_pnl per coin and day; a day is that of ``time_ms``, which copies share.

    A third field, always zero, counts the fills themselves, whatever is null in them.
    """
    fills = table(spark, folder, "raw_fills").withColumn(COUNTED, F.lit(0).cast("decimal(20,8)"))
    days = fills.select("coin", "fee", "closed_pnl", COUNTED, "fill_key", F.floor(F.col("time_ms") / 86_400_000).alias("day"))
    return partial_counts(days, "coin", ["fee", "closed_pnl", COUNTED], "day", "fill_key")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    known = percentiles(_daily(spark, folder), ["0.1", "0.5", "0.9"])
    at = lambda field, p: F.max(F.when((F.col("field") == field) & (F.col("p") == p), F.col("value").cast("double")))
    limits = known.groupBy(F.col("group").alias("of_coin")).agg(at("fee", 0.5).alias("mid"), at("closed_pnl", 0.1).alias("p10"), at("closed_pnl", 0.9).alias("p90"), F.max(F.when(F.col("field") == COUNTED, F.col("n"))).alias("fills"))
    limits = limits.where(F.col("fills") >= MIN_FILLS)
    fills = table(spark, folder, "raw_fills").select("fill_key", "coin", F.col("fee").cast("double"), F.col("closed_pnl").cast("double"))
    fills = fills.join(small_or_shuffled(limits, MAX_BROADCAST_COINS), F.col("coin") == F.col("of_coin"))
    spread = 12 * (F.col("p90") - F.col("p10"))
    fee = F.when(F.col("fee") > 20 * F.col("mid"), "fee")
    pnl = F.when((F.col("closed_pnl") > F.col("p90") + spread) | (F.col("closed_pnl") < F.col("p10") - spread), "closed_pnl")
    return fills.select("fill_key", F.explode(F.array_compact(F.array(fee, pnl))).alias("field")).distinct()


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles of every coin."""
    known = percentiles(_daily(spark, folder).where(F.col("field") != COUNTED), PERCENTILES)
    return known.select(F.col("group").alias("coin"), "field", "p", "n", F.col("value").cast("decimal(38,10)").alias("value"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_in_time(table(spark, folder, "raw_fills"), table(spark, folder, "builder_logs"), "fill_key", "log_id")


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of 2,048 tokens from all documents, each piece placed by balanced cost."""
    return packed(table(spark, folder, "documents"), "doc_id", "text", 2048, repair=False)


def p6_tight(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the repair that moves placed pieces to save the last sequences."""
    return packed(table(spark, folder, "documents"), "doc_id", "text", 2048)


def _mixed(spark: SparkSession, folder: str) -> Mix:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """A mix as large as the corpus: one row per use of a document."""
    return _mixed(spark, folder).chosen


def p7_sharded(spark: SparkSession, folder: str) -> DataFrame:
    """The same mix in small blocks and shards, at which the tree has many nodes at any scale."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), block_tokens=1 << 13, shard_tokens=1 << 17).chosen


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder).shares


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return assign(documents, fit(documents, table(spark, folder, "subject_labels"), table(spark, folder, "subject_areas")))


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents each subject has, and their share of all documents."""
    documents = table(spark, folder, "documents").agg(F.count(F.lit(1))).scalar()
    counts = p8_found(spark, folder).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    return counts.select("subject", "documents", (F.col("documents") / documents).alias("share"))


QUERIES = {q.__name__: q for q in (p1_found, p1_percentiles, p4_found, p6_packed, p6_tight, p7_mix, p7_sharded, p7_shares, p8_found, p8_composition)}

_FILLS = """f AS (SELECT fill_key, any_value(coin) AS coin, CAST(any_value(fee) AS DOUBLE) AS fee, CAST(any_value(closed_pnl) AS DOUBLE) AS closed_pnl
      FROM raw_fills GROUP BY fill_key)"""

SQL = {
    "p1_found": f"""WITH {_FILLS},
q AS (SELECT coin, quantile_cont(fee, 0.5) AS mid, quantile_cont(closed_pnl, 0.1) AS p10, quantile_cont(closed_pnl, 0.9) AS p90
      FROM f GROUP BY coin HAVING count(*) >= {MIN_FILLS})
SELECT fill_key, 'fee' AS field FROM f JOIN q USING (coin) WHERE fee > 20 * mid
UNION ALL
SELECT fill_key, 'closed_pnl' FROM f JOIN q USING (coin) WHERE closed_pnl > p90 + 12 * (p90 - p10) OR closed_pnl < p10 - 12 * (p90 - p10)""",
    "p1_percentiles": f"""WITH
f AS (SELECT fill_key, any_value(coin) AS coin, any_value(fee) AS fee, any_value(closed_pnl) AS closed_pnl FROM raw_fills GROUP BY fill_key),
x AS (SELECT coin, 'fee' AS field, fee AS v FROM f UNION ALL SELECT coin, 'closed_pnl', closed_pnl FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY coin, field ORDER BY v) - 1 AS place, count(*) OVER (PARTITION BY coin, field) AS n FROM x WHERE v IS NOT NULL),
t AS (SELECT *, unnest([{", ".join(str(round(float(p) * 100)) for p in PERCENTILES)}]) AS c FROM (SELECT DISTINCT coin, field, n FROM r)),
u AS (SELECT *, c * (n - 1) // 100 AS lo, c * (n - 1) % 100 AS w FROM t)
SELECT u.coin, u.field, CAST(u.c AS DOUBLE) / 100 AS p, u.n,
       CAST((CAST(a.v AS DECIMAL(38,10)) * (100 - u.w) + coalesce(CAST(b.v AS DECIMAL(38,10)), 0) * u.w) * 0.01 AS DECIMAL(38,10)) AS value
FROM u JOIN r a ON a.coin = u.coin AND a.field = u.field AND a.place = u.lo
LEFT JOIN r b ON b.coin = u.coin AND b.field = u.field AND b.place = u.lo + 1""",
    "p4_found": """WITH
f AS (SELECT DISTINCT fill_key, lower("user") AS u, lower(coin) AS c, side, px, sz, time_ms FROM raw_fills),
l AS (SELECT log_id, lower("user") AS u, lower(coin) AS c, side, px, sz, time_ms FROM builder_logs),
m AS (SELECT fill_key, log_id, row_number() OVER (PARTITION BY fill_key ORDER BY abs(f.time_ms - l.time_ms), log_id) AS place
      FROM f JOIN l ON f.u = l.u AND f.c = l.c AND f.side = l.side AND abs(f.px - l.px) <= 0.000001 AND abs(f.sz - l.sz) <= 0.000001
                   AND abs(f.time_ms - l.time_ms) <= 1000)
SELECT fill_key, log_id FROM m WHERE place = 1""",
}
