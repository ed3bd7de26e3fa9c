"""Plateworks plans."""
