"""Where file entries come from: directory trees, tables, default roots."""
