"""Registered queries over the test tables (``queries()`` / ``oracle_sql()``)."""
