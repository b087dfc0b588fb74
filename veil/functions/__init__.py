"""Column-expression builders: masking, keyed hashing, keyed noise, pandas.cut binning math,
Python-style text, the regex dialect bridge and SQL function registration."""
