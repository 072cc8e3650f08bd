"""Structured Streaming front end over the batch plans."""
