"""Views, the registry, and the registered queries."""
