"""Evidence-first web extraction and corpus analytics on Spark."""
