"""Column expressions: validators, regular-expression helpers, text folding."""
