"""Column types of the ledger tables. Widths are chosen so that products and sums stay exact in 38 digits."""

from __future__ import annotations

PRICE = "decimal(18,8)"
MONEY = "decimal(20,8)"
NET = "decimal(28,8)"
NOTIONAL = "decimal(38,16)"
TOTAL = "decimal(38,8)"
AVERAGE = "decimal(28,12)"

FILLS = (
    f"user string, coin string, time_ms long, side string, px {PRICE}, sz {PRICE}, fee {MONEY}, closed_pnl {MONEY}, "
    f"builder_fee {MONEY}, tid long, oid long, fill_key string"
)
DEPOSITS = f"user string, time_ms long, amount {MONEY}, tx_hash string, event_key string"
EQUITY_SNAPSHOTS = f"id long, user string, time_ms long, equity {MONEY}"
ATTRIBUTIONS = "fill_key string, attributed boolean, mode string, confidence string, builder string"
BUILDER_LOGS = f"day string, time_ms long, user string, coin string, side string, px {PRICE}, sz {PRICE}, tid long, oid long"

#: The order of the fills of a wallet and coin; nulls come first.
FILL_ORDER = ["time_ms", "tid", "oid", "fill_key"]
