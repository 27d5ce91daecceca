"""Operators over transcripts."""
