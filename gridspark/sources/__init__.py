"""Readers: text indexes, listings, products, catalogues, manifests, telemetry, rasters."""
