"""The ingest tick as a Structured Streaming sink."""
