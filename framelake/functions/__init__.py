"""Column expressions: bit vectors, perceptual hashes, signatures, geometry, display."""
