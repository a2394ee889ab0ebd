"""Column-level building blocks: keys, time, termination conditions."""
