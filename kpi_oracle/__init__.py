"""DuckDB statements of every registered query (the correctness oracle).

Written from the report semantics, independently of the DataFrame plans; see
``kpi_oracle.sql``.
"""
