"""quillbar: a Spark-first analytics engine for market-data tables."""
