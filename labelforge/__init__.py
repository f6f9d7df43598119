"""labelforge: building, splitting, scoring and auditing labelled-text benchmarks as Spark jobs."""
