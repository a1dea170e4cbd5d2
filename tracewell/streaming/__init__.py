"""Streams of run events."""
