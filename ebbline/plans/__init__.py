"""Model graph, pipeline runner, and the registered queries."""
