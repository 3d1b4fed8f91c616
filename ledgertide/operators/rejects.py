"""Splitting raw delimited records into valid rows and rejects with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rule table: which check a column has to pass. A column without a rule may hold anything.
RULES = {"side": "side", "px": "positive_number", "sz": "positive_number"}
#: Up to so many files, the headers are sent to every task; beyond, records and headers are shuffled by file.
MAX_BROADCAST_FILES = 20_000

# The words for a side, the shape of a price or size. (?i:) is ASCII only in Java.
BUY = r"\A(?i:a|buy|bid)\z"
SELL = r"\A(?i:b|sell|ask)\z"
NUMBER = r"\A[0-9]{1,10}(?:\.[0-9]{1,8})?\z"

_ESC = "\u0001"
_SEP = _ESC + "b"


def cells(record: Column) -> Column:
    """The fields of a record as they stand, quotes included.

    A comma separates if an even number of quotes precedes it. For records that follow RFC 4180 these
    are the fields; for others at least one cell fails :func:`well_quoted`. Written without a regular
    expression over the record, whose length is not bounded.
    """
    pieces = F.split(F.replace(record, F.lit(_ESC), F.lit(_ESC + "a")), '"', -1)
    outside = lambda piece, i: F.when(i % 2 == 0, F.replace(piece, F.lit(","), F.lit(_SEP))).otherwise(piece)
    found = F.split(F.array_join(F.transform(pieces, outside), '"'), _SEP, -1)
    return F.transform(found, lambda c: F.replace(c, F.lit(_ESC + "a"), F.lit(_ESC)))


def well_quoted(cell: Column) -> Column:
    """Wholly in double quotes with inner quotes doubled, or free of double quotes."""
    inner = F.replace(F.substr(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit(""))
    quoted = (F.length(cell) >= 2) & F.startswith(cell, F.lit('"')) & F.endswith(cell, F.lit('"')) & ~F.contains(inner, F.lit('"'))
    return ~F.contains(cell, F.lit('"')) | quoted


def unquoted(cell: Column) -> Column:
    inner = F.replace(F.substr(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    return F.when(F.startswith(cell, F.lit('"')), inner).otherwise(cell)


def bare(value: Column) -> Column:
    """Without spaces and tabs at both ends."""
    return F.btrim(value, F.lit(" \t"))


def passes(kind: Column, value: Column) -> Column:
    """Whether a value passes the check of that kind; null never does."""
    number = F.rlike(value, F.lit(NUMBER)) & F.rlike(value, F.lit("[1-9]"))
    side = F.rlike(value, F.lit(BUY)) | F.rlike(value, F.lit(SELL))
    return F.coalesce(F.when(kind == "side", side).when(kind == "positive_number", number), F.lit(False))


def parsed(df: DataFrame) -> DataFrame:
    """``(record_id, file_name, record_no, names, cells, broken)`` of every record but the headers.

    ``names`` are the columns of the file's header (record 1; of several, the one with the smallest
    ``record_id``), null if it has none; ``broken`` is the structural reason or null.
    """
    df = df.select("record_id", "file_name", "record_no", "record")
    heads = df.where(F.col("record_no") == 1)
    names = F.transform(cells(F.col("record")), lambda c: F.lower(bare(unquoted(c))))
    heads = heads.groupBy(F.col("file_name").alias("of_file")).agg(F.min_by("record", F.struct("record_id")).alias("record")).select("of_file", names.alias("names"))
    few = df.where(F.col("record_no") == 1).select("file_name").distinct().limit(MAX_BROADCAST_FILES + 1).count() <= MAX_BROADCAST_FILES
    rows = df.where(F.coalesce(F.col("record_no") != 1, F.lit(True))).withColumn("cells", cells(F.col("record")))
    rows = rows.join(F.broadcast(heads) if few else heads, F.col("file_name") == F.col("of_file"), "left")
    count_differs = F.coalesce(F.size("cells") != F.size("names"), F.lit(True)) | F.col("record").isNull()
    broken = F.when(~F.forall("cells", well_quoted), "quoting").when(count_differs, "column_count")
    return rows.select("record_id", "file_name", "record_no", "names", F.transform("cells", unquoted).alias("cells"), broken.alias("broken"))


def rejects(rows: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """``(record_id, reason)`` of the records of :func:`parsed` that cannot be read, without repeats.

    Every record is exploded once into (record, column, value) and joined with the rule table; each value
    that fails gives the name of its column. A broken record is one entry that holds its structural
    reason; a rule's column that the header lacks is an entry without value.
    """
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame(list(rules.items()), "rule_column string, kind string"))
    entry = lambda column, value, reason: F.struct(column.alias("column"), value.alias("value"), reason.alias("reason"))
    none = F.lit(None).cast("string")
    named = F.transform(F.arrays_zip(F.col("names").alias("n"), F.col("cells").alias("c")), lambda x: entry(x["n"], x["c"], none))
    absent = F.transform(F.array_except(F.array(*map(F.lit, rules)), "names"), lambda x: entry(x, none, none))
    entries = F.when(F.col("broken").isNotNull(), F.array(entry(none, none, F.col("broken")))).otherwise(F.concat(named, absent))
    long = rows.select("record_id", F.explode(entries).alias("entry")).select("record_id", "entry.column", "entry.value", "entry.reason")
    judged = long.join(table, F.col("column") == F.col("rule_column"), "left")
    failed = F.col("kind").isNotNull() & ~passes(F.col("kind"), bare(F.col("value")))
    return judged.where(F.col("reason").isNotNull() | failed).select("record_id", F.coalesce("reason", "column").alias("reason")).distinct()


def split_records(df: DataFrame, rules: dict[str, str] = RULES) -> tuple[DataFrame, DataFrame]:
    """The valid rows of raw records, and the rejects with their reasons.

    ``df`` has ``record_id``, ``file_name`` (builder/yyyymmdd…), ``record_no`` (1 = header) and
    ``record``. The first table is the records without any reject, found by an anti-join, as builder-log
    rows ``(record_id, builder, day, time_ms, user, coin, side, px, sz, tid, oid)``; the second is
    ``(record_id, reason)``.

    A null ``record`` and every record of a file without header are rejected as ``column_count``; a
    null ``record_no`` is a record, not a header; rows that share a ``record_id`` (null included) are
    judged together. Times that can't be read become null, as the time is never the reason of a reject.
    An empty table gives two empty tables. Extra columns are not looked at.
    """
    rows = parsed(df)
    bad = rejects(rows, rules)
    ids = bad.select(F.col("record_id").alias("bad_id")).distinct()
    clean = rows.join(ids, F.col("record_id").eqNullSafe(F.col("bad_id")), "left_anti")
    value = lambda name: F.try_element_at("cells", F.nullif(F.array_position("names", F.lit(name)).cast("int"), F.lit(0)))
    side = F.when(F.rlike(bare(value("side")), F.lit(BUY)), "buy").when(F.rlike(bare(value("side")), F.lit(SELL)), "sell")
    valid = clean.select(
        "record_id",
        F.split("file_name", "/").getItem(0).alias("builder"),
        F.nullif(F.regexp_extract("file_name", "([0-9]{8})[^/]*$", 1), F.lit("")).alias("day"),
        F.unix_millis(F.try_to_timestamp(bare(value("time")))).alias("time_ms"),
        value("user").alias("user"),
        value("coin").alias("coin"),
        side.alias("side"),
        bare(value("px")).try_cast("decimal(18,8)").alias("px"),
        bare(value("sz")).try_cast("decimal(18,8)").alias("sz"),
        F.lit(None).cast("long").alias("tid"),
        F.lit(None).cast("long").alias("oid"),
    )
    return valid, bad
