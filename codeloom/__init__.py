"""codeloom: code-graph construction, hybrid retrieval and agent-log analytics as Spark plans."""
