"""Streams of frames and stateful operators."""
