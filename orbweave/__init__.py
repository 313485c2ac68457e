"""Spark batch jobs for network-latency measurements."""
