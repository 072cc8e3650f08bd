"""Readers and writers: text, CSV grids, Office packages, sessions, exports."""
