"""tidelane: price/volume bar analytics as Spark DataFrame plans."""
