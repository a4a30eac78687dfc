"""Analytics operators.  Each takes the tables and parameters and returns a lazy DataFrame."""
