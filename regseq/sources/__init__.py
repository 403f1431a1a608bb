"""Readers and writers of sequence, interval, ortholog and hit files."""
