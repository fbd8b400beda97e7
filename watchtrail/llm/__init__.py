"""Operators that prepare a training corpus: each module is one operator, built on DataFrames."""
