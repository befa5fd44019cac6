"""Search over texts that come in chunks."""
