"""Registry of queries and of the SQL that gives their expected results."""

QUERIES = {}
ORACLES = {}


def register(name: str, run, sql: str | None = None) -> None:
    """`run(spark, sf_dir)` gives a DataFrame; `sql` gives the same rows on the same tables."""
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql
