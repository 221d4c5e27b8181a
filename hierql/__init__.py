"""hierql: a process query language over hierarchical event logs, on Spark DataFrames."""
