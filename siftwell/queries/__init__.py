"""Runnable queries over the provided tables, each with the SQL that states its result."""
