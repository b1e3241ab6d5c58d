"""Readers and writers for corpora, vector stores, records and artefacts."""
