"""tessera: cell, frame, palette and event analytics as Spark plans."""
