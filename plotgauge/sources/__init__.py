"""Readers and writers of the evaluation's files."""
