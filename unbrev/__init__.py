"""Shorthand expansion and token normalisation as Spark table jobs."""

from unbrev.profile import LATIN, RU, Profile
from unbrev.settings import EditCosts, Settings, Weights

__all__ = ["LATIN", "RU", "EditCosts", "Profile", "Settings", "Weights"]
