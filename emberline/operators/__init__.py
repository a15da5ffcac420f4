"""DataFrame operators: spatial joins, lookups, roll-ups, rankings and report tables."""
