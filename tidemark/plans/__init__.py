"""Query plans: the SQL corpus and the engine that runs statements."""
