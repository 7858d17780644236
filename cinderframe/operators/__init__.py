"""Operators: DataFrame to DataFrame, lazy but for the written rounds of graph work."""
