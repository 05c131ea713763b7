"""All check statements."""

from . import oracle, oracle_etl, oracle_lists, oracle_spatial  # noqa: F401

statements = oracle.statements
