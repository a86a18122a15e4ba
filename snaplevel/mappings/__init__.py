"""Mapping sets: which source columns make an information element present."""

from snaplevel.mappings.model import Alternative, Element, MappingSet
from snaplevel.mappings.builtin import default_mapping

__all__ = ["Alternative", "Element", "MappingSet", "default_mapping"]
