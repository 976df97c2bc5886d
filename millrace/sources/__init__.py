"""Readers: files, delimited text, tables and pipeline exports."""
