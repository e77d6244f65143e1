"""Registered queries, their input tables, and the SQL they are checked against."""
