"""Column-level building blocks: vector metrics, predicates, text analysis, sealing, placement."""
