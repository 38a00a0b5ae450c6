"""Every registered query of the library's own operators, with its SQL twin."""

from lavra.plans import corpus, files, items, profile, registry, scalars, vectors

_PLANS = (profile, scalars, corpus, registry, vectors, items, files)
QUERIES: dict = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
