"""The queries that run on the given tables, with equivalent SQL."""
