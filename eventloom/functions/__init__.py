"""The function library. load() registers all of it."""

from __future__ import annotations


def load() -> dict:
    from . import codecs, collections, convert, crypto, grok, network, numbers, parsers, strings, types  # noqa: F401
    from .registry import FUNCTIONS

    return FUNCTIONS
