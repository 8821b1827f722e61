"""ledgerlens: bank-statement analytics written as Spark DataFrame jobs.

Sub-packages:
  functions  Column -> Column expressions (text, dates, money, merchant names, rule matching)
  sources    readers: statement CSV, code-list text, warehouse tables, test-data derivations
  operators  DataFrame -> DataFrame steps: clean, categorise, load, views, roll-ups, audits
  plans      composed end-to-end queries and their SQL oracle text
  streaming  Structured Streaming ingest (idempotent micro-batch load, watermark dedup)
"""

__version__ = "0.1.0"
