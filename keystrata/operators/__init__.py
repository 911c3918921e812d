"""Query and write operators; the query builders return lazy DataFrames."""
