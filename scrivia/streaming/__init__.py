"""Scrivia streaming."""
