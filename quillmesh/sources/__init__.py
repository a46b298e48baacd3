"""Readers: files, manifests, graphs, golden cases, logs, glossaries."""
