"""Landed feed pages, vocabulary and dataset files, and sinks."""
