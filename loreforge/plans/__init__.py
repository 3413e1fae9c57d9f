"""Registered queries: each applies operators to the tables of a folder, with the SQL that it must agree with."""
