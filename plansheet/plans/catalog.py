"""All queries over the given tables and their SQL for another engine."""

from plansheet.plans import scalars, work

QUERIES = scalars.QUERIES | work.QUERIES
ORACLE_SQL = scalars.ORACLE_SQL | work.ORACLE_SQL
