"""Files of reads: sources, sinks and their names."""
