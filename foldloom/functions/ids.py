"""Identity of a series: six stored codes and the keys derived from them, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

CODES = ("network", "station", "location", "channel", "model", "weight")


def _code(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _joined(*names: str) -> Column:
    return F.concat_ws(".", *[_code(n) for n in names])


def id_keys() -> dict[str, Column]:
    """All thirteen keys. A null code counts as an empty one.

    id is network.station.location.channel, followed by model.weight where either is set; instrument is the channel's
    id without its last letter, component that letter.
    """
    nslc, modwt = _joined("network", "station", "location", "channel"), _joined("model", "weight")
    return {
        **{name: _code(name) for name in CODES},
        "nslc": nslc,
        "sncl": _joined("station", "network", "channel", "location"),
        "id": F.when(modwt == ".", nslc).otherwise(F.concat_ws(".", nslc, modwt)),
        "site": _joined("network", "station", "location"),
        "instrument": F.concat_ws(".", _joined("network", "station", "location"), F.expr("substring(coalesce(channel, ''), 1, greatest(length(coalesce(channel, '')) - 1, 0))")),
        "component": F.expr("right(coalesce(channel, ''), 1)"),
        "modwt": modwt,
    }


#: other names that selections may use
ALIASES: Mapping[str, str] = {"inst": "instrument", "comp": "component", "mod": "modwt"}


def id_key(name: str) -> Column:
    """One key by its name or alias."""
    keys = id_keys()
    name = ALIASES.get(name, name)
    if name not in keys:
        raise ValueError(f"unknown id key {name!r}; known are {', '.join(keys)}")
    return keys[name]


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression of a shell pattern: * ? [seq] [!seq]; all else is literal."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        close = pattern.find("]", at + 2 + (pattern[at + 1 : at + 2] == "!")) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            inside = pattern[at + 1 : close]
            negated = inside.startswith("!")
            inside = re.sub(r"([\\\[\]^&~|])", r"\\\1", inside[negated:])
            out.append(f"[{'^' if negated else ''}{inside}]")
            at = close
        else:
            out.append(re.sub(r"([^0-9A-Za-z_])", r"\\\1", c))
        at += 1
    return f"(?s)^{''.join(out)}$"


def matches(column: Column, pattern: str) -> Column:
    """Whether a value fits a shell pattern; a pattern without special letters is an equality, which scans can use."""
    return column.rlike(glob_to_regex(pattern)) if re.search(r"[*?\[]", pattern) else column == pattern
