"""Operators: DataFrame in, DataFrame out, nothing executed until an action."""
