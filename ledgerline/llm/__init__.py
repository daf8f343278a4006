"""Operators on text corpora for training data. Nothing else in the package imports this folder."""
