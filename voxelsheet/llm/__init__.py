"""Operators for preparing language-model training data.

Every operator is a function from DataFrames to a DataFrame. Texts are read
whole; null texts count as empty. Clashing or extra input columns do no harm:
operators pick the columns they need by name and return the ones they document.
"""
