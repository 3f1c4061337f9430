"""Query registry, oracle SQL twins, stored intermediates and plan checks."""
