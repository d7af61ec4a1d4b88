"""Operators for preparing training corpora.  Nothing else in this library imports this subpackage."""
