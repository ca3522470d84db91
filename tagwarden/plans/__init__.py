"""Plan-level helpers (size-proven broadcasts) and the query registry."""
from tagwarden.plans.broadcast import broadcast_if_small, literal_lookup

__all__ = ["broadcast_if_small", "literal_lookup"]
