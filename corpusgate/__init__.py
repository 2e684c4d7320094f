"""Spark jobs that scan, gate and score large tables of files, documents, commits and review reports."""
