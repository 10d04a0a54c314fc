"""Readers: tables and their views as signals."""
