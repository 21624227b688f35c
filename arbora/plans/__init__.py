"""Action plans and the sinks that carry them out."""
