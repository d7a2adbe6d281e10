"""doclake: document-corpus operators expressed as Spark DataFrame jobs."""
