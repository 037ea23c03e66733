"""End-to-end flows (analyse, launch, compare) and the query registry."""
