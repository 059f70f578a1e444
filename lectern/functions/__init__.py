"""Part of the Lectern engine."""
