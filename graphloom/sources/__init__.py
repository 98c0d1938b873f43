"""Readers, sinks and stores."""
