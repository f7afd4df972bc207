"""Queries of the library over the test tables, with the SQL that each one equals."""
