"""Queries over the input tables for every operator, with the same in SQL where it can be said."""
