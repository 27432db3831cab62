"""Raster artwork and print geometry as Spark relations.

An image is the rows (image_id, y, x, ...) of a pixel relation; masks, components, contours,
meshes and layer plans are further relations with the same key.
"""
