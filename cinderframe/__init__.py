"""Spark jobs over a wildfire record: perimeters, severity grids, repeat burns, trails and tiles."""
