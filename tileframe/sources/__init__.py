"""Readers and writers: tiles, files, annotation indexes, manifests, summaries, contract tables and reports."""

from tileframe.sources.readers import *  # noqa: F403
from tileframe.sources.writers import *  # noqa: F403
