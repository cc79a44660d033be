"""Readers and writers of sequence formats, on Spark's text source."""
