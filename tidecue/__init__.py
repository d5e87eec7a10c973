"""Time-coded dialogue analytics on PySpark."""
