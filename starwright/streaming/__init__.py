"""Incremental loading of files as they land in a stage folder."""
