"""Streams: fenced writes as keyed state, deduplication, and jobs that drain what is there."""
