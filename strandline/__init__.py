"""strandline: evidence-graph and change-impact analytics as Spark jobs."""
