"""ledgerline: portfolio and market analytics as Spark DataFrame jobs.

Modules:
    sources    scans, fixtures, keyed table maintenance (upsert, delete, append)
    functions  column helpers
    operators  ledger history, positions, market, accounts, audits, skew-safe scans
    streaming  Structured Streaming forms of the trigger logic
    plans      query registry with SQL oracles, SQL table functions, verification
"""
