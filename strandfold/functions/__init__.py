"""Column builders for sequences, alignments and thresholds."""
