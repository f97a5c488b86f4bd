"""Part of maskwell."""
