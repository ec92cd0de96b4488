"""Document analytics on Spark: revisions, retrieval, text quality, evaluation and a corpus pipeline."""
