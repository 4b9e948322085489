"""Evidence-backed document analysis as Spark jobs."""
