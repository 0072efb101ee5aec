"""textloom: document retrieval and text analytics expressed as Spark plans."""
