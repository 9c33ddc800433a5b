"""Readers of quotes, sheets, lists and documents."""
