"""Concurrency analytics over tables, on PySpark: nets, state spaces, detectors, closures and fact translation."""
