"""Registered queries and the stage runner."""
