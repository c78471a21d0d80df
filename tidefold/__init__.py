"""Convergent analytics on PySpark: lattice merges, sketches, causal joins and telemetry as DataFrame plans."""
