"""Operators that prepare text, code and vectors as training data. Nothing else in the library imports this."""
