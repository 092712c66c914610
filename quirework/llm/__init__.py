"""Operators for preparing training data: classifiers, near-duplicate joins, mixing, token files and packing."""
