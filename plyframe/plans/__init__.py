"""Queries over the driver's tables.  Each module has QUERIES: name -> (query, SQL or None)."""
