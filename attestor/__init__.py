"""Evidence analytics on Spark: declarative document, event and evaluation operators."""
