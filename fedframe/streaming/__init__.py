"""Event streams over Structured Streaming (an extension: the dialect itself has no streams)."""
