"""Change feeds of file trees for Structured Streaming."""
