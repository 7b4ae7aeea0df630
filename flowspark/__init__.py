"""Network-flow analytics as plain DataFrame operators and Structured Streaming jobs."""
