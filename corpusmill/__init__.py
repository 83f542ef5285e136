"""corpusmill: document retrieval analytics and corpus preparation as Spark DataFrame programs."""
