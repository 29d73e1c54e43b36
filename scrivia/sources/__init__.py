"""Scrivia sources."""
