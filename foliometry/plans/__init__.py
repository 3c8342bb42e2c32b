"""Registered queries of the library."""
