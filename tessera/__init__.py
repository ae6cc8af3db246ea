"""tessera: document analytics and retrieval as Spark DataFrame programs."""
