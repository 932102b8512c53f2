"""Species trees from genomes as DataFrame computations."""
