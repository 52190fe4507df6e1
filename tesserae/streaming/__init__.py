"""Streams: events to sessions, chunks of texts to their order, and runs that stop and go on where they were."""
