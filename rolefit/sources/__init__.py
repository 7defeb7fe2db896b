"""Readers and writers: feed snapshots, versioned datasets, payloads, user tables."""
