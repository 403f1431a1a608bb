"""regseq: comparative regulatory-sequence analysis as DataFrame jobs."""
