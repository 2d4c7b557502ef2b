"""Training-data operators: scanning, mixing, de-duplication, scoring and sharding of documents."""
