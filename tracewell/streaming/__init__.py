"""Empty on purpose: the workload has no streams, so there is nothing to express as Structured Streaming."""
