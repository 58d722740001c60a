"""Checks of physical plans."""
