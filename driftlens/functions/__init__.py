"""Column functions without Python row work."""
