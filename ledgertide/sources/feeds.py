"""Records of the fill, deposit and margin feeds, from JSON text to typed rows and back."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.functions.keys import decimal_text, event_key, fill_key
from ledgertide.functions.keys import tx_hash as keys_tx_hash
from ledgertide.schema import BUILDER_LOGS, MONEY, PRICE
from ledgertide.sources.sinks import replace_partitions

# Names in the records and the letters for a side.
FILL_FIELDS = "time string, side string, px string, sz string, fee string, closedPnl string, builderFee string, tid string, oid string"
SIDES = {"A": "buy", "B": "sell"}
KEPT_TYPES = ["deposit", "withdraw"]


#: A decimal as text: digits with at most one point, no exponent and nothing around it.
DECIMAL = r"\A[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\z"


def _number(value: Column, kind: str) -> Column:
    """The number a text holds, rounded to the places of ``kind``; null if it isn't one or is too large."""
    return F.when(F.rlike(value, F.lit(DECIMAL)), value).try_cast(kind)


def records_of(answers: DataFrame, column: str) -> DataFrame:
    """One row per record of the JSON arrays in ``column``, as JSON text in ``record``; what isn't an array has none."""
    others = [c for c in answers.columns if c != column]
    each = F.try_variant_get(F.try_parse_json(column), "$", "array<variant>")
    return answers.select(*others, F.explode(each).alias("__each")).select(*others, F.to_json("__each").alias("record"))


def parsed_equity(answers: DataFrame, column: str) -> DataFrame:
    """``(user, equity)`` of account answers whose ``equity`` is a number in a text."""
    rows = answers.select("user", _number(F.get_json_object(column, "$.equity"), MONEY).alias("equity"))
    return rows.where(F.col("equity").isNotNull())


def parsed_fills(records: DataFrame, column: str) -> DataFrame:
    """Fills from JSON texts in ``column``, beside the table's other columns (``user`` and ``coin`` among them).

    A record without a readable time, side, price, size, fee or closedPnl is skipped; ``tid``, ``oid``
    and ``builderFee`` may be missing. Numbers may be written as texts.
    """
    # generated, not projected: a projection would be copied into every use and parse the text as often
    rows = records.select("*", F.explode(F.array(F.from_json(column, FILL_FIELDS))).alias("__r"))
    f = lambda n: F.col(f"__r.{n}")
    side = F.when(f("side") == "A", SIDES["A"]).when(f("side") == "B", SIDES["B"])
    rows = rows.withColumns(
        {
            "time_ms": _number(f("time"), "long"),
            "side": side,
            "px": _number(f("px"), PRICE),
            "sz": _number(f("sz"), PRICE),
            "fee": _number(f("fee"), MONEY),
            "closed_pnl": _number(f("closedPnl"), MONEY),
            "builder_fee": _number(f("builderFee"), MONEY),
            "tid": _number(f("tid"), "long"),
            "oid": _number(f("oid"), "long"),
        }
    ).drop("__r", column)
    return rows.na.drop(subset=["time_ms", "side", "px", "sz", "fee", "closed_pnl"]).withColumn("fill_key", fill_key())


def fill_as_json() -> Column:
    text = lambda c: decimal_text(F.col(c))
    side = F.when(F.col("side") == "buy", "A").otherwise("B")
    return F.to_json(
        F.struct(
            F.col("time_ms").alias("time"), side.alias("side"), text("px").alias("px"), text("sz").alias("sz"), text("fee").alias("fee"),
            text("closed_pnl").alias("closedPnl"), text("builder_fee").alias("builderFee"), "tid", "oid",
        )
    )


def parsed_deposits(records: DataFrame, column: str) -> DataFrame:
    """Deposits from JSON texts.

    By what ``delta`` is: of an object the amount is its ``usdc``, and its ``type``, if it says one, must be
    a deposit or a withdrawal; a text is the amount; where there is no ``delta`` it is ``amount``. Any
    other ``delta`` is an error, as is an amount that isn't a text. Amounts keep their sign. Records with an
    error or without a whole-number ``time`` are skipped, as are texts that aren't JSON.
    """
    whole = F.try_parse_json(column)
    part = lambda path: F.try_variant_get(F.col("__v"), path, "variant")
    is_a = lambda path, kind: F.coalesce(F.startswith(F.schema_of_variant(part(path)), F.lit(kind)), F.lit(False))
    text = lambda path: F.when(is_a(path, "STRING"), F.try_variant_get(F.col("__v"), path, "string"))
    nested, kind = is_a("$.delta", "OBJECT"), text("$.delta.type")
    amount = F.when(nested, text("$.delta.usdc")).when(part("$.delta").isNull(), text("$.amount")).otherwise(text("$.delta"))
    time = F.when(is_a("$.time", "BIGINT"), F.try_variant_get(F.col("__v"), "$.time", "long"))
    # generated, not projected: a projection would be copied into every use and parse the text as often
    rows = records.withColumn("__v", F.explode(F.array(whole))).where(~nested | kind.isNull() | kind.isin(KEPT_TYPES))
    rows = rows.withColumns({"time_ms": time, "amount": _number(amount, MONEY), "tx_hash": keys_tx_hash(F.coalesce(text("$.hash"), text("$.txHash")))})
    return rows.drop("__v", column).na.drop(subset=["time_ms", "amount"]).withColumn("event_key", event_key())


def deposit_as_json() -> Column:
    """Every record nested; negative amounts as withdrawals."""
    kind = F.when(F.col("amount") < 0, "withdraw").otherwise("deposit")
    delta = F.struct(kind.alias("type"), decimal_text(F.col("amount")).alias("usdc"))
    return F.to_json(F.struct(F.col("time_ms").alias("time"), delta.alias("delta"), F.col("tx_hash").alias("hash")))


POSITION = (
    "coin string, szi string, entryPx string, positionValue string, unrealizedPnl string, liquidationPx string, "
    "leverage string, marginUsed string, maxLeverage string"
)


def risk_positions(reports: DataFrame, column: str) -> DataFrame:
    """Open positions of margin reports, one row each; missing numbers are "0".

    A size that is zero or can't be read isn't open; an entry without ``position`` is passed over.
    ``leverage`` may be a number or an object with ``value``.
    """
    others = [c for c in reports.columns if c != column]
    rows = reports.select(*others, F.explode(_entries(column)).alias("e")).where("e.position is not null").select(*others, "e.position.*")
    rows = rows.where(F.coalesce(_number(F.col("szi"), PRICE), F.lit(0)) != 0)
    return rows.select(*others, _position(F.col).alias("p")).select(*others, "p.*")


_ENTRIES = f"array<struct<position: struct<{POSITION.replace(' string', ': string')}>>>"


def _entries(column: str) -> Column:
    return F.from_json(F.get_json_object(column, "$.assetPositions"), _ENTRIES)


def _position(field: Callable[[str], Column]) -> Column:
    text = lambda c: F.coalesce(field(c), F.lit("0"))
    leverage = F.coalesce(F.get_json_object(field("leverage"), "$.value"), field("leverage"), F.lit("0"))
    return F.struct(
        field("coin").alias("coin"),
        _number(field("szi"), PRICE).alias("size"),
        text("entryPx").alias("entry_px"),
        text("positionValue").alias("position_value"),
        text("unrealizedPnl").alias("unrealized_pnl"),
        field("liquidationPx").alias("liquidation_px"),
        leverage.alias("leverage"),
        text("marginUsed").alias("margin_used"),
        text("maxLeverage").alias("max_leverage"),
    )


# The account figures of a margin report and what they are called here.
SUMMARY = {"accountValue": "account_value", "totalMarginUsed": "total_margin_used", "totalNtlPos": "total_notional", "totalRawUsd": "total_raw", "withdrawable": "withdrawable"}


def risk_summary(reports: DataFrame, column: str) -> DataFrame:
    """The account figures of margin reports, "0" where missing."""
    others = [c for c in reports.columns if c != column]
    found = [F.coalesce(F.get_json_object(column, f"$.marginSummary.{k}"), F.get_json_object(column, f"$.{k}"), F.lit("0")).alias(v) for k, v in SUMMARY.items()]
    return reports.select(*others, *found)


def risk_report(reports: DataFrame, column: str) -> DataFrame:
    """Positions (an array, in the report's order) and account figures of each margin report, as ``positions`` and ``summary``.

    A report without ``marginSummary``, or that isn't JSON, can't be answered and is left out. A report is
    one account's, so its array is as long as its positions are many.
    """
    others = [c for c in reports.columns if c != column]
    known = reports.where(F.get_json_object(column, "$.marginSummary").isNotNull())
    summary = F.struct(*[F.coalesce(F.get_json_object(column, f"$.marginSummary.{k}"), F.get_json_object(column, f"$.{k}"), F.lit("0")).alias(v) for k, v in SUMMARY.items()])
    entries = F.coalesce(_entries(column), F.array().cast(_ENTRIES))
    held = F.filter(entries, lambda e: e["position"].isNotNull() & (F.coalesce(_number(e["position"]["szi"], PRICE), F.lit(0)) != 0))
    return known.select(*others, F.transform(held, lambda e: _position(lambda n: e["position"][n])).alias("positions"), summary.alias("summary"))


def risk_as_json() -> Column:
    """Aggregate ``coin``, ``szi`` and ``px`` into a margin report."""
    leverage = F.struct(F.lit("cross").alias("type"), F.lit(20).alias("value"))
    position = F.struct("coin", decimal_text(F.col("szi")).alias("szi"), decimal_text(F.col("px")).alias("entryPx"), leverage.alias("leverage"))
    return F.to_json(F.struct(F.collect_list(F.struct(position.alias("position"))).alias("assetPositions")))


def builder_log_csv(spark: SparkSession, path: str) -> DataFrame:
    """Strict reader of builder logs ``<builder>/<yyyymmdd>.csv``: any bad row fails the read.

    Each file's own header says which column is which, whatever their number and order. Files are grouped by
    header, and each group is read by name, split and in parallel where its records are lines. A header
    without one of ``LOG_COLUMNS`` and a record with another number of fields than its header fail the
    read. For reading with rejects set apart see ``operators.rejects``.
    """
    options = {"recursiveFileLookup": True, "pathGlobFilter": "*.csv"}
    heads = spark.read.format("binaryFile").options(**options).load(path).select("path", F.substring("content", 1, MAX_HEADER).alias("head"))
    by_header: dict[str, list[str]] = {}
    for r in heads.mapInArrow(_first_records, "path string, header string").collect():  # one row for each file and day
        by_header.setdefault(r.header, []).append(r.path)
    logs = None
    for header, files in by_header.items():
        names = json.loads(header)
        missing = [c for c in LOG_COLUMNS if c not in names]
        if missing:
            raise ValueError(f"{files[0]}: no column {missing[0]}")
        once = [f"{n}_{i}" if names.index(n) != i else n for i, n in enumerate(names)]
        kinds = ", ".join(f"`{n.replace('`', '``')}` string" for n in once)
        rows = spark.read.schema(kinds).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").option("columnPruning", False).option("multiLine", True).option("escape", '"').csv(files)
        typed = _typed_log(rows, F.input_file_name())
        logs = typed if logs is None else logs.unionByName(typed)
    return logs if logs is not None else spark.createDataFrame([], BUILDER_LOGS)


#: A header is at most so many bytes long.
MAX_HEADER = 1 << 20


def _first_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        heads = [json.dumps(next(csv.reader(io.StringIO(h.decode("utf-8-sig", "ignore"), newline="")), [])) for h in b.column("head").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(heads, pa.string())], names=["path", "header"])


def builder_logs(spark: SparkSession, base: str, builder: str | None = None, from_day: str | None = None, to_day: str | None = None) -> DataFrame:
    """Builder logs stored as ``base/builder=…/day=yyyymmdd``; only the asked builder's and days' folders are read."""
    rows = spark.read.parquet(base)
    rows = rows.withColumns({"builder": F.col("builder").cast("string"), "day": F.col("day").cast("string")})
    if builder is not None:
        rows = rows.where(F.col("builder") == builder)
    if from_day is not None:
        rows = rows.where(F.col("day") >= from_day)
    return rows if to_day is None else rows.where(F.col("day") <= to_day)


def store_builder_day(spark: SparkSession, file: str, base: str) -> None:
    """Read one ``<builder>/<yyyymmdd>.csv`` or ``.csv.lz4`` strictly and store it over its builder's day below ``base``."""
    builder = file.rstrip("/").split("/")[-2]
    rows = builder_log_lz4(spark, file) if file.endswith(".lz4") else builder_log_csv(spark, file)
    replace_partitions(rows.withColumn("builder", F.lit(builder)), base, ["builder", "day"])


LOG_COLUMNS = ["time", "user", "coin", "side", "px", "sz"]


def builder_log_lz4(spark: SparkSession, path: str) -> DataFrame:
    """Strict reader of builder logs in LZ4 frames, ``<builder>/<yyyymmdd>.csv.lz4``, otherwise as :func:`builder_log_csv`.

    A file is unpacked as a whole in one task. A cut or broken frame, a record with another number of
    fields than the header, and a header without one of ``LOG_COLUMNS`` fail the read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv.lz4").option("recursiveFileLookup", True).load(path)
    rows = files.select("path", "content").mapInArrow(_unpacked, ", ".join(f"{c} string" for c in ["path", *LOG_COLUMNS]))
    return _typed_log(rows, F.col("path"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content")):
            with pa.input_stream(content.as_buffer(), compression="lz4") as frames:
                records = csv.reader(io.StringIO(frames.read().decode("utf-8-sig"), newline=""), strict=True)
            header = next(records, None)
            if header is None:
                raise ValueError(f"{path}: no header")
            at = [header.index(c) for c in LOG_COLUMNS]
            out = []
            for r in records:
                if not r:
                    continue
                if len(r) != len(header):
                    raise ValueError(f"{path}: {len(r)} fields, {len(header)} in the header")
                out.append([path, *[r[i] or None for i in at]])
            columns = zip(*out) if out else [()] * (len(LOG_COLUMNS) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["path", *LOG_COLUMNS])


def _typed_log(rows: DataFrame, file_name: Column) -> DataFrame:
    word = F.lower(F.trim("side"))
    side = F.when(word.isin("a", "buy", "bid"), "buy").when(word.isin("b", "sell", "ask"), "sell").otherwise(F.raise_error(F.concat(F.lit("unknown side "), F.coalesce("side", F.lit("null")))).cast("string"))
    return rows.select(
        F.regexp_extract(file_name, r"([0-9]{8})[^/]*$", 1).alias("day"),
        F.unix_millis(F.to_timestamp("time")).alias("time_ms"),
        "user",
        "coin",
        side.alias("side"),
        F.col("px").cast(PRICE).alias("px"),
        F.col("sz").cast(PRICE).alias("sz"),
        F.lit(None).cast("long").alias("tid"),
        F.lit(None).cast("long").alias("oid"),
    )
