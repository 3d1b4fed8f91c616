"""Checks of query parameters, made before any plan is built."""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation

MAX_MS = 2**63 - 1
METRICS = ("volume", "pnl", "returnpct")


class RequestError(Exception):
    """A request that can't be answered, with the status it is answered with."""

    status = 500

    def body(self) -> dict[str, str]:
        return {"error": str(self)}


class BadRequest(RequestError, ValueError):
    """A parameter that can't be used."""

    status = 400


class NotFound(RequestError, LookupError):
    """Something named in the request that isn't there."""

    status = 404


class Internal(RequestError, RuntimeError):
    """Anything that isn't the request's fault."""


def error_answer(error: Exception) -> tuple[int, dict[str, str]]:
    """Status and body for any error; one that isn't a RequestError is internal."""
    known = error if isinstance(error, RequestError) else Internal(str(error))
    return known.status, known.body()


def address(value: str) -> str:
    if not re.fullmatch(r"0x[0-9a-fA-F]{40}", value or ""):
        raise BadRequest(f"invalid address: {value!r}")
    return value


def optional_address(value: str | None) -> str | None:
    return None if value is None else address(value)


def wallet_like(value: str) -> str:
    """The weaker check of risk requests: prefix and length only."""
    if not (value or "").startswith("0x") or len(value.encode()) != 42:
        raise BadRequest(f"invalid address: {value!r}")
    return value


def window(from_ms: int | None, to_ms: int | None, ordered: bool = True) -> tuple[int, int]:
    """Both ends inclusive. Trade listings don't insist on the order of the ends."""
    lo, hi = 0 if from_ms is None else from_ms, MAX_MS if to_ms is None else to_ms
    if ordered and lo > hi:
        raise BadRequest("fromMs must not be after toMs")
    return lo, hi


def coin(value: str | None, blank: str = "none", trim: bool = False) -> str | None:
    """``blank``: whether an empty coin means all coins ("none") or is an error ("error")."""
    if value is not None and trim:
        value = value.strip()
    if value == "":
        if blank == "error":
            raise BadRequest("coin must not be empty")
        return None
    return value


def metric(value: str | None) -> str:
    found = (value or "").strip().lower()
    if found not in METRICS:
        raise BadRequest(f"unknown metric {value!r}")
    return found


def capital(value: str | None) -> Decimal | None:
    if value is None:
        return None
    try:
        number = Decimal(value)
    except InvalidOperation as e:
        raise BadRequest(f"invalid maxStartCapital {value!r}") from e
    if not number.is_finite():
        raise BadRequest(f"invalid maxStartCapital {value!r}")
    return number


def user_list(text: str) -> list[str]:
    """Wallets separated by commas or line breaks: trimmed, without empty and repeated ones, in order."""
    return sorted({u.strip() for u in re.split(r"[,\n]", text) if u.strip()})


def fetch_from(from_ms: int, lookback_ms: int = 86_400_000) -> int:
    """Where a fetch has to start so that late rows are seen again."""
    return max(0, from_ms - lookback_ms)
