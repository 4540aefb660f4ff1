"""Shared intermediate tables of the registered queries, built with the library's operators.

Tables that several branches of one plan read (groups, receipt side, matched groups) are
materialized, so the plan below them runs once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripledger.functions.materialize import materialize
from tripledger.operators import fx, matching, statements
from tripledger.plans.bindings import view


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.rate_table(view(spark, sf_dir, "fx_observations"))


def cad_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = statements.exact_cad_audit(view(spark, sf_dir, "statement_legs"))
    return statements.apply_weekly_fx(legs, rates(spark, sf_dir))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.transaction_groups(cad_legs(spark, sf_dir))


def receipt_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(receipt side with estimates, groups)."""
    g = materialize(groups(spark, sf_dir))
    receipts = view(spark, sf_dir, "receipts")
    plain = matching.receipt_side(receipts)
    estimates = fx.estimate_receipt_cad(
        plain.drop("estimated_cad"), g.filter("match_eligible"), rates(spark, sf_dir)
    )
    return materialize(matching.receipt_side(receipts, estimates)), g


def matched_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(receipt side, groups with match columns)."""
    side, g = receipt_sides(spark, sf_dir)
    return side, materialize(matching.match_groups(side, g))


def decided_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound groups with dispositions and allocations applied."""
    from tripledger.operators import decisions

    decided = decisions.apply_dispositions(view(spark, sf_dir, "matched_groups"), view(spark, sf_dir, "dispositions"))
    return decisions.allocation_totals(decided, view(spark, sf_dir, "allocations"))


def program_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tripledger.operators import lines

    return lines.program_inclusion(view(spark, sf_dir, "receipt_lines"))


def reconciled(spark: SparkSession, sf_dir: str, decided: DataFrame | None = None) -> DataFrame:
    """Receipts with CAD totals, source, basis and rate; decided: the decided groups, where a query has written them."""
    from tripledger.operators import claims, decisions

    receipts = decisions.statement_basis(view(spark, sf_dir, "receipts"), view(spark, sf_dir, "basis"))
    groups = decided_groups(spark, sf_dir) if decided is None else decided
    totals = claims.receipt_cad_totals(groups, view(spark, sf_dir, "allocations"), receipts)
    return claims.reconciled_receipts(claims.cad_source(receipts, totals))


def expenses(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, settled: DataFrame | None = None) -> DataFrame:
    """Claim amounts of every receipt (CLM6); rows, settled: the program lines and reconciled receipts, where a query has written them."""
    from tripledger.operators import claims, lines

    program = view(spark, sf_dir, "trips").select("trip_id", "claim_program")
    base = (reconciled(spark, sf_dir) if settled is None else settled).join(program, "trip_id")
    return claims.expense_result(lines.receipt_totals(program_lines(spark, sf_dir) if rows is None else rows, base))
