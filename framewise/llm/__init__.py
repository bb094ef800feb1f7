"""Training-data operators: thirteen jobs over text tables, each a plain function of DataFrames."""
