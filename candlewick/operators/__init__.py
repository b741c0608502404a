"""The operators. Importing this package registers all of them."""

from . import averages, folds_averages, folds_momentum, folds_trend, folds_volume, momentum, trend, volume  # noqa: F401
from .registry import OPERATORS, Operator, operator  # noqa: F401
