"""Every query of the library by name, with its oracle."""

from .plans import allele, contrast, matrix, misc, rest, sequence

_ALL = matrix.Q | allele.Q | sequence.Q | misc.Q | contrast.Q | rest.Q


def queries():
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
