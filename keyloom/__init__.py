"""Finding, judging and reporting hardcoded credentials with DataFrames."""
