"""Column functions: normalisation and digests."""
