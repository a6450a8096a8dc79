"""All registered queries by id, each over whole given tables, with the same question as SQL."""

from saldo.queries import changes, ingest, reads, relational

MODULES = (reads, relational, ingest, changes)


def queries() -> dict:
    return {name: build for module in MODULES for name, build in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: text for module in MODULES for name, text in module.ORACLE.items()}
