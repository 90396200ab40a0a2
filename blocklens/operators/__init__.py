"""Relational operators over extents, layers, references, bitmaps and snapshots."""
