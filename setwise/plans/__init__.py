"""Query catalogue: DataFrame plans with their SQL."""
