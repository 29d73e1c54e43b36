"""Scrivia functions."""
