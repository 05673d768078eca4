"""tidemark: analytics over a ledger of workflow step executions, on PySpark."""
