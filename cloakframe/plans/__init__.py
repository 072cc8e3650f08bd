"""Whole runs composed of operators: anonymise, detect, and the registered queries."""
