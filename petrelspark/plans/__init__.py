"""Input schemas, the net bundle, literal fixtures and inputs derived from the tables."""
