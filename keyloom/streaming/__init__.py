"""Structured Streaming ingest of keyword rows: an extension, the batch operators have no streaming counterpart."""
