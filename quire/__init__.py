"""quire: document-structure analytics on Spark."""
