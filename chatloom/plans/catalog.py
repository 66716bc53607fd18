"""All queries outside the optional subpackage, and the SQL they are compared with."""

from chatloom.plans import engine_queries, problems, report_queries

QUERIES = {**problems.QUERIES, **report_queries.QUERIES, **engine_queries.QUERIES}
ORACLES = {**problems.ORACLES, **report_queries.ORACLES, **engine_queries.ORACLES}
