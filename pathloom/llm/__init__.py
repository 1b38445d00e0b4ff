"""Training-data operators: thirteen operators on documents, conversations and embeddings and their registered queries."""
