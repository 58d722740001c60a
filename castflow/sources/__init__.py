"""Readers and writers of feeds, state files, metadata, transcripts, templates and notes."""
