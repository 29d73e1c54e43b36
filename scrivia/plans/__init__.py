"""Scrivia plans."""
