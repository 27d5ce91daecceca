"""Signals, segments and speakers."""
