"""Lending-risk analytics on Spark: exact ledgers, valuation and stress as DataFrame jobs."""
