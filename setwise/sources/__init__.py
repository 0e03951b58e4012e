"""Readers and writers of binary set formats and of text sets."""
