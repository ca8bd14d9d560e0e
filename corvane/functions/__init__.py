"""Column functions: text rules, identities, classification codes."""
