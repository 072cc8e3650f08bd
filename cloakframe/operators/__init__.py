"""Relational operators over regions, spans, values, suggestions and the registry."""
