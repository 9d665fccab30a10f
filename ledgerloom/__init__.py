"""Company filings and financial statements as Spark DataFrames."""
