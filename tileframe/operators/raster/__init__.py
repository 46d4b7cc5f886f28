"""Raster operators over pixel tables (tile_id, y, x, ...)."""
