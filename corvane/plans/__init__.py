"""Compositions: the engine facade, and the driver tables seen as records."""
