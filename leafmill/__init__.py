"""Retrieval and question answering over paginated documents, as Spark jobs."""
