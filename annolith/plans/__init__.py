"""The registered queries and the SQL that checks them."""

from . import files, matrix, search, tables

QUERIES = {**search.QUERY, **matrix.QUERY, **tables.QUERY, **files.QUERY}
ORACLE_SQL = {**search.SQL, **matrix.SQL, **tables.SQL, **files.SQL}
