"""Incremental re-screening and the streaming surface."""
