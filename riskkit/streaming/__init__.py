"""Batch and streaming scoring."""
