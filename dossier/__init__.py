"""Evidence pipelines on Spark: ingest, text preparation, person resolution, claims, retrieval and operations analytics."""
