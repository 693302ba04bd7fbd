"""Writers: generations behind a pointer, packed rows, pyramids, provenance."""
