"""The policy of a run, the ordered fold and the engine that puts operators together."""
