"""Inputs: bank files, exchange rates, streams, and the ledger written from them."""

from ledgerscope.sources.files import read_accounts, read_transactions
from ledgerscope.sources.ledger import land_ledger, read_ledger
from ledgerscope.sources.numbered_lines import WHOLE, delivered_lines, numbered_transactions, read_lines, stream_lines
from ledgerscope.sources.rates import read_fx_rates, with_btc_rates
from ledgerscope.sources.streams import stream_transactions

__all__ = [
    "WHOLE",
    "delivered_lines",
    "land_ledger",
    "numbered_transactions",
    "read_accounts",
    "read_fx_rates",
    "read_ledger",
    "read_lines",
    "read_transactions",
    "stream_lines",
    "stream_transactions",
    "with_btc_rates",
]
