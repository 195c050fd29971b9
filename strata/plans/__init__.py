"""Query plans: registered queries, oracle SQL and rule-based dispatch."""
