"""Model specifications and the models composed from operators."""
