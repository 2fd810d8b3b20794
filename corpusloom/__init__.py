"""corpusloom: a Spark engine for searching and analysing document corpora."""
