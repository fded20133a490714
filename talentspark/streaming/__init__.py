"""The analysis requests as a stream of landed texts."""
