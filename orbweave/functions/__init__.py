"""Part of the latency analytics library."""
