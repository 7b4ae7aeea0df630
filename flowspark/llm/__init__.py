"""Training-data operators over documents, benchmark items and embeddings."""
