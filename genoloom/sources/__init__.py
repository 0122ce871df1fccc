"""Readers and writers of sequence, annotation, alignment and result files."""
