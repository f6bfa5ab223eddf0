"""Column functions on sequences, descriptions and lineages."""
