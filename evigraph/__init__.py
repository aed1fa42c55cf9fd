"""evigraph: evidence-backed knowledge graphs as Spark tables."""
