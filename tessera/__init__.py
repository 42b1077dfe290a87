"""tessera: corpus and usage analytics as Spark DataFrame programs."""
