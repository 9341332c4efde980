"""Threading analytics on Spark: documents to chronological threads, and the measures of both."""
