"""The query language and its compilation to DataFrames."""
