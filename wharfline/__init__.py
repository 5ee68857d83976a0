"""Table-centred data portability on Spark: profiling, bounded extraction, dumps, rewriting, verification and swap planning as DataFrame functions."""
