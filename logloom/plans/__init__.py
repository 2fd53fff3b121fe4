"""Multi-step analyses composed from operators."""
