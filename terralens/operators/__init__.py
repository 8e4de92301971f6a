"""Relational, temporal and spatial operators, all DataFrame in, DataFrame out."""
