"""Query registry, oracle SQL and the action pipeline."""
