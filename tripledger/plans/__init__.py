"""Bindings to the test tables, registered queries and end-to-end plans."""

from importlib import import_module

MODULES = ("q_statements", "q_matching", "q_decisions", "q_claims", "q_receipt_text", "q_ingest", "q_reports", "q_review", "q_streams")


def load_all() -> None:
    for name in MODULES:
        import_module(f"tripledger.plans.{name}")
