"""Readers of IR text and run folders, and writers of nets, graphs and reports."""
