"""Registered queries of the library and their SQL."""

from . import text, web

QUERIES = text.BOOK.queries | web.BOOK.queries
ORACLES = text.BOOK.sql | web.BOOK.sql
