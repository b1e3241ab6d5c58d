"""Training-data operators and the corpus pipeline; nothing else in the library imports this package."""
