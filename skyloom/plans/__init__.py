"""Plans: the store, the daily run, the brief and the registered queries."""
