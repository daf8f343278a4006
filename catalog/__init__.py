"""Registered queries over the driver tables, each with the SQL that must give the same rows."""
