"""Relational operators: retail reports, load strategies, constraints, catalog look-ups."""
