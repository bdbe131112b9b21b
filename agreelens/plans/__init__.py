"""Example inputs derived from the driver tables, the registered queries, and their oracle SQL."""
