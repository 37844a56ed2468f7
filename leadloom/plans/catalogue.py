"""All queries and oracles outside the training-data subpackage."""

from leadloom.plans import elements, failures, fields, markup, pages, persisted, relational, streams, textual, wording

_PARTS = (relational, persisted, textual, elements, pages, streams, failures, fields, wording, markup)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
