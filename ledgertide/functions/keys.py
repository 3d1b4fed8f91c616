"""Deterministic keys and codes as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_text(value: Column) -> Column:
    """A decimal without exponent and without zeros at the end of its fraction."""
    text = value.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def _little_endian(value: Column, digits: int) -> Column:
    """The hex digits of a whole number, bytes in reverse order; negative numbers in two's complement."""
    big = F.lpad(F.hex(value.cast("long")), digits, "0")
    return F.concat(*[F.substring(big, i + 1, 2) for i in range(digits - 2, -2, -2)])


def _long(value: Column) -> Column:
    return _little_endian(value, 16)


def _text(value: Column) -> Column:
    """Length in bytes (32 bits) and bytes, so that neighbouring texts can't run into each other."""
    return F.concat(_little_endian(F.octet_length(value), 8), F.hex(F.encode(value, "UTF-8")))


def _optional(value: Column, encoded: Column) -> Column:
    return F.when(value.isNull(), F.lit("00")).otherwise(F.concat(F.lit("01"), encoded))


def _digest(parts: list[Column]) -> Column:
    return F.concat(F.lit("hash:"), F.substring(F.sha2(F.unhex(F.concat(*parts)), 256), 1, 32))


def fill_key() -> Column:
    """``user:coin:tid:<tid>``, or without a tid a hash of the fill's fields."""
    c = F.col
    by_tid = F.concat_ws(":", c("user"), c("coin"), F.lit("tid"), c("tid").cast("string"))
    by_hash = _digest(
        [
            _text(c("user")),
            _text(c("coin")),
            _long(c("time_ms")),
            F.when(c("side") == "buy", "42").otherwise("53"),
            *[_text(decimal_text(c(n))) for n in ("px", "sz", "fee", "closed_pnl")],
            _optional(c("builder_fee"), _text(decimal_text(c("builder_fee")))),
            _optional(c("oid"), _long(c("oid"))),
        ]
    )
    return F.when(c("tid").isNotNull(), by_tid).otherwise(by_hash)


def tx_hash(value: Column) -> Column:
    """Trimmed and in lower case; null if blank."""
    return F.lower(F.nullif(F.trim(value), F.lit("")))


def event_key() -> Column:
    """The transaction hash of a deposit, or without one a hash of its fields."""
    c = F.col
    by_hash = _digest([_text(c("user")), _long(c("time_ms")), _text(decimal_text(c("amount")))])
    return F.coalesce(tx_hash(c("tx_hash")), by_hash)


def lifecycle_id(opener: Column) -> Column:
    """63 bits of the SHA-256 of the opening fill's key (its first eight bytes, little-endian), never zero."""
    digest = F.sha2(opener, 256)
    low_first = F.concat(*[F.substring(digest, i + 1, 2) for i in range(14, -2, -2)])
    value = (F.conv(low_first, 16, 10).cast("decimal(20,0)") % F.lit(Decimal(2**63))).cast("long")
    return F.when(value == 0, F.lit(1).cast("long")).otherwise(value)


def utc_day(time_ms: Column) -> Column:
    """``yyyymmdd`` of milliseconds since the epoch, in UTC whatever the session's zone."""
    return F.date_format(F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(time_ms / 86_400_000).cast("int")), "yyyyMMdd")


def place(time_ms: Column, tie: Column) -> Column:
    """Time and a whole number as one number that orders as both do, so that a latest row is found by hashing.

    Times are to have at most 18 digits.
    """
    above_zero = tie.cast("decimal(20,0)") + F.lit(Decimal(2**63)).cast("decimal(20,0)")
    return (time_ms.cast("decimal(18,0)").cast("decimal(38,0)") * F.lit(Decimal(10**20)).cast("decimal(21,0)")).cast("decimal(38,0)") + above_zero


def sign_of(side: Column) -> Column:
    return F.when(side == "sell", -1).otherwise(1)


def is_address(value: Column) -> Column:
    return F.coalesce(F.rlike(value, F.lit(r"\A0x[0-9a-fA-F]{40}\z")), F.lit(False))
