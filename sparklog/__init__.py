"""Semi-structured text logs as typed DataFrames."""
