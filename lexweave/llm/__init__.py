"""Training-data operators: filtering, de-duplication, mixing and sharding of document tables."""
