"""Operators on texts, names and matches for training data. Nothing else in the package imports this one."""
