"""Training-data operators: one module each, plus the query registry in ``queries``."""
