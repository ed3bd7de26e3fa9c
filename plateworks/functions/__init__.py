"""Plateworks functions."""
