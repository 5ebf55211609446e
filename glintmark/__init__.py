"""glintmark: credential detection and corpus analytics as Spark DataFrame jobs."""
