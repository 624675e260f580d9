"""Relational, spatial, raster, graph and learning operators as DataFrame builders."""
