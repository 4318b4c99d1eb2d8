"""Structured Streaming of closed bars."""
