"""Readers and writers, and the pluggable edges: document layout and language-model providers."""
