"""Cross-sectional signal and walk-forward analytics as Spark DataFrame operators."""
