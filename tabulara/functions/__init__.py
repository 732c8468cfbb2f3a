"""Part of tabulara."""
