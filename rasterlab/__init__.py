"""Data work around pixel-labelled raster imagery, as DataFrame operations."""
