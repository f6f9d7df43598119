"""Incremental processing of report files."""
