"""weftgraph: graph-and-vector retrieval analytics expressed as Spark DataFrame plans."""
