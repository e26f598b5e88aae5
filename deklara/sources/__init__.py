"""Declared text files in, reports and records out."""
