"""Secret and personal-data scanning, and the data preparation around it, planned as Spark DataFrames."""
