"""All registered queries but those of the training-data subpackage, with their DuckDB oracles."""

from evidence_engine.queries import audit, feeds, gates, governance, graph, intake, news, reports

MODULES = (news, graph, audit, feeds, reports, gates, intake, governance)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
