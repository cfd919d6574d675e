"""Source-code audit as Spark jobs: files in, findings, metrics, scores and history out."""
