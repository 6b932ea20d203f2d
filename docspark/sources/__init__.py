"""Readers, sinks and row envelopes."""
