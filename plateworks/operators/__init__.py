"""Plateworks operators."""
