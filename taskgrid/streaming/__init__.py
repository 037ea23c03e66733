"""Structured Streaming: analyse task lists as they are uploaded."""
