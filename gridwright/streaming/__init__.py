"""Structured Streaming: job messages, their fold, and event windows."""
