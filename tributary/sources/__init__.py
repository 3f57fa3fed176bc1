"""Tables and feeds as DataFrames."""
