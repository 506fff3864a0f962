"""Scans that turn raw files and tables into turn or chunk frames."""
