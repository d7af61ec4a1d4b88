"""Column expressions: firing rules on marking arrays, and name classification."""
