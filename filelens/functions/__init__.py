"""Column expressions: paths, classification, sizes, digests, wording."""
