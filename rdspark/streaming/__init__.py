"""Structured Streaming jobs: result ingest, running quality, packet state."""
