"""Evidence analytics over whole corpora of recordings, as Spark jobs."""
