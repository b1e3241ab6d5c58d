"""Column-level building blocks: hashing, text, vectors, answer scoring."""
