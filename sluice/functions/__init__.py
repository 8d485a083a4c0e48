"""Column functions: calendar labels, keys, fingerprints, basis digests."""
