"""File-source stream ingest."""
