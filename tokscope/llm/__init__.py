"""Operators for preparing large text corpora for model training.

Each module holds one operator with a general DataFrame interface;
``queries.py`` registers a thin query per operator. Nothing else in the
library imports this package.
"""
