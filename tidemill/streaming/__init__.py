"""Structured Streaming: sources, keyed state, exactly-once sinks, bounded runs."""
