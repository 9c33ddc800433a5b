"""Registered queries and whole-cycle plans."""
