"""Operators over documents and postings: set algebra, bitmaps, index, ranking."""
