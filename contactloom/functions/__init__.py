"""Column expressions: normalisers, rules, match keys."""
