"""Column expressions: keys, stamps, intervals, percentiles."""
