"""Readers, adapter views over the test tables, and sinks."""
