"""Scrivia operators."""
