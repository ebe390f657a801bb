"""clausemill: clause graphs, retrieval and corpus preparation as Spark plans."""
