"""Operators for preparing large text corpora.  Nothing outside imports this."""
