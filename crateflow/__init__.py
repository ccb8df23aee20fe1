"""Crateflow: similarity-driven sequencing and data preparation for media libraries, on PySpark."""
