"""Whole-query plans."""
