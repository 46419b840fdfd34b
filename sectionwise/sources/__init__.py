"""Readers that turn files and tables into the line relation."""
