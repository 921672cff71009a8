"""Annotated chess books as relational tables: block, move and board operators on Spark DataFrames."""
