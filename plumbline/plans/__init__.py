"""Whole programs: the relational queries, the store check, repair plans."""
