"""Extraction scoring and the corruption benchmark."""
