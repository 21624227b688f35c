"""Column-level building blocks: paths, names, sizes, hashes, ordinals."""
