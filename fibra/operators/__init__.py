"""Signal operators: each takes samples (or results of others) and returns a DataFrame."""
