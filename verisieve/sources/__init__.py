"""Readers of bundles, logs, transcripts and files, and the projections of star-schema tables."""
