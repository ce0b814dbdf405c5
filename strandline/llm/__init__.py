"""Operators for large training-text corpora; nothing else in strandline imports this subpackage."""
