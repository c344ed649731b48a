"""Tables of the engine, read from files or derived from other tables."""
