"""Extensions over Structured Streaming."""
