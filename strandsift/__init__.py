"""Analysis of sequence collections with Spark: k-mers, de Bruijn graphs, unitigs and full-text queries."""
