"""Documentation-corpus engine on PySpark: URL algebra, HTML extraction, link graphs, lint, state tables."""
