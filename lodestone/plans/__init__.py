"""The query builder and the registered queries."""
