"""Scans, state and configuration."""
