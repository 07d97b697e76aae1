"""geoloom: geographic and corpus analytics expressed as Spark plans."""
