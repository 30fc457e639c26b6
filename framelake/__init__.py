"""A Spark engine for sequence copy detection over perceptual fingerprints."""
