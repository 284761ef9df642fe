"""foliant: document and portfolio analytics expressed as Spark plans."""
