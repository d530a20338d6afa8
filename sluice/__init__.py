"""sluice: a small analytics engine on PySpark."""
