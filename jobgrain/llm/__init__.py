"""Training-data operators: ten distributed jobs over documents, vectors and conversations."""
