"""Operators over net, graph and trace tables."""
