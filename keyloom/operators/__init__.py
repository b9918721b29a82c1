"""Operators of the data-structure families, each a DataFrame-to-DataFrame function."""
