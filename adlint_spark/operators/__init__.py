"""Operators over documents, elements, findings and verdicts."""
