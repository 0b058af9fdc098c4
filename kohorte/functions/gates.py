"""Row gates: which transactions, invoices and customers count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARGE = 0
REFUND = 1


def successful(txn: DataFrame) -> DataFrame:
    return txn.where(F.col("transaction_status") == 1)


def successful_charges(txn: DataFrame) -> DataFrame:
    return successful(txn).where(F.col("transaction_type") == CHARGE)


def successful_refunds(txn: DataFrame) -> DataFrame:
    return successful(txn).where(F.col("transaction_type") == REFUND)


def invoiced(txn: DataFrame, invoices: DataFrame, *, numbered: bool = True, legacy: bool = False) -> DataFrame:
    """Keep transactions that have an invoice (``numbered``: one with a number).

    The gate is a semi join, so a transaction with two invoices stays one row;
    ``legacy=True`` repeats it per invoice as a plain inner join does.
    """
    keys = invoices.where(F.col("invoice_number").isNotNull()) if numbered else invoices
    keys = keys.select(F.col("transaction_id").alias("id"))
    return txn.join(keys, "id", "inner" if legacy else "left_semi")


def external_customers(customers: DataFrame, pattern: str, *, keep_missing: bool = False) -> DataFrame:
    """Drop internal accounts. Customers without an address go too, unless ``keep_missing``."""
    outside = ~F.col("email").like(pattern)
    return customers.where(outside | F.col("email").isNull() if keep_missing else outside)


def outside_all(column: str, patterns: list[str]) -> Column:
    """The weak exclusion as a condition: false only where **every** pattern matches, NULL for NULL."""
    keep = ~F.col(column).like(patterns[0])
    for pattern in patterns[1:]:
        keep = keep | ~F.col(column).like(pattern)
    return keep


def not_all_like(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """The weak exclusion: a row goes only if it matches **every** pattern (or is NULL)."""
    return df.where(outside_all(column, patterns))
