"""Named queries over the given tables, each with its SQL counterpart."""

from __future__ import annotations

from . import audio, bouts, feeds, labelling, matrices, naming, recordings, scoring, streams, vessels

MODULES = (bouts, labelling, vessels, audio, matrices, scoring, naming, feeds, recordings, streams)


def registry() -> dict:
    """name -> (query, sql or None)"""
    out = {}
    for mod in MODULES:
        for name, pair in mod.QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} is defined twice")
            out[name] = pair
    return out
