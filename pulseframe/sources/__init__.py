"""Readers of health exports and logs, and the sinks that write results."""
