"""Queries over the standard tables; importing a module of this folder registers all of them."""

from loamwork.plans import catalogue as catalogue
from loamwork.plans import derivation as derivation
from loamwork.plans import sweeping as sweeping
from loamwork.plans import upkeep as upkeep
