"""Dropping keys from JSON documents whose schema and depth are not known."""

from __future__ import annotations

import json

import pandas as pd


class Number(str):
    """A number as it is written in the document."""


def _pairs(items: list[tuple]) -> dict:
    return {"pairs": items}


def without_keys(text: str | None, dropped: frozenset[str]) -> str | None:
    """The document without the named keys (any case) of its objects, at any
    depth, but not below arrays; compact, with keys in their order and numbers
    as written.  A text that is not one JSON document, or one that nests too
    deep to be read, gives None: it may hold what is to be dropped."""
    if text is None:
        return None
    try:
        read = json.loads(text, object_pairs_hook=_pairs, parse_float=Number, parse_int=Number, parse_constant=Number)
    except (ValueError, RecursionError):
        return None
    out: list[str] = []
    todo: list = [(read, True)]  # what is still to be written, last first; the flag ends below arrays
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        value, open_ = x
        if isinstance(value, dict):
            kept = [(k, v) for k, v in value["pairs"] if not (open_ and k.lower() in dropped)]
            todo.append("}")
            for i in range(len(kept) - 1, -1, -1):
                k, v = kept[i]
                todo += [(v, open_), f"{',' if i else ''}{json.dumps(k, ensure_ascii=False)}:"]
            todo.append("{")
        elif isinstance(value, list):
            todo.append("]")
            for i in range(len(value) - 1, -1, -1):
                todo.append((value[i], False))
                if i:
                    todo.append(",")
            todo.append("[")
        else:
            out.append(str(value) if isinstance(value, Number) else json.dumps(value, ensure_ascii=False))
    return "".join(out)


def dropper(dropped: frozenset[str]):
    def drop(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: without_keys(t, dropped) if isinstance(t, str) else None)

    return drop
