"""Operators for preparing training data: ten text and vector operators, each a function over DataFrames."""
