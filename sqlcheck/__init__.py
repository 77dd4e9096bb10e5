"""The same results as plain SQL over the warehouse tables, for an independent check in DuckDB."""

from sqlcheck.statements import SQL

__all__ = ["SQL"]
