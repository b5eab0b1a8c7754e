"""From models and requests to plans, and from plans to DataFrames and SQL."""
