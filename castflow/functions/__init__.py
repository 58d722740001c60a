"""Column functions and storage helpers."""
