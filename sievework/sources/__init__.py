"""Readers of published lists, uploads, pages and feeds. Every list reader gives the columns of ``RECORD``."""
