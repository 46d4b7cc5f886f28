"""Column expressions over tiles, masks, probabilities, paths and records."""

from tileframe.functions.columns import *  # noqa: F403
