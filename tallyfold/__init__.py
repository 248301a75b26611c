"""Decision-event ledgers and document refinement on Spark DataFrames."""
