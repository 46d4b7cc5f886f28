"""Tile rasters, segmentation evaluation and text preparation as Spark DataFrame operators."""
