"""DataFrame operators: parsing, chunking, search, context and answers."""
