"""Checks of requests and edits: plain Python, raised as ValueError with the reason."""

from __future__ import annotations

import math
import re

SEED = re.compile(r"[A-Za-z0-9_.|:-]+")
GROUP = re.compile(r"[A-Za-z0-9_.-]+")
NAME = re.compile(r"[A-Za-z0-9_.-]+")


def split_input(text: str) -> list[str]:
    """Parts between white space, commas and semicolons."""
    return [x for x in re.split(r"[\s,;]+", text or "") if x]


def seeds(value: str | list[str], most: int = 10, longest: int = 64) -> list[str]:
    """Distinct seeds in order."""
    got = list(dict.fromkeys(split_input(value) if isinstance(value, str) else [str(x).strip() for x in value if str(x).strip()]))
    if not got:
        raise ValueError("at least one seed is needed")
    if len(got) > most:
        raise ValueError(f"at most {most} seeds are allowed")
    for s in got:
        if len(s) > longest or not SEED.fullmatch(s):
            raise ValueError(f"bad seed: {s}")
    return got


def max_nodes(value: int | None, default: int = 500, cap: int = 2500) -> int:
    if value is None:
        return default
    if isinstance(value, bool) or int(value) != value or not 1 <= value <= cap:
        raise ValueError(f"the number of nodes must lie between 1 and {cap}")
    return int(value)


def csv_name(value: str, longest: int = 100) -> str:
    """A file name that ends in .csv, without folders."""
    name = (value or "").strip()
    name = name if name.lower().endswith(".csv") else f"{name}.csv"
    if not NAME.fullmatch(name) or name.startswith(".") or len(name) > longest or name.lower() == ".csv":
        raise ValueError(f"bad name: {value}")
    return name


def ids(values: list, most: int, what: str = "ids") -> list[str]:
    """Distinct ids, trimmed, in order."""
    if not isinstance(values, list):
        raise ValueError(f"{what} must be a list")
    got = list(dict.fromkeys(str(v).strip() for v in values if str(v).strip()))
    if len(got) > most:
        raise ValueError(f"at most {most} {what} are allowed")
    return got


def edge_ids(values: list, most: int = 200_000) -> list[str]:
    """Distinct `a|b` ids with their ends in order."""
    out = {}
    for v in ids(values, most, "edges"):
        ends = [x.strip() for x in v.split("|")]
        if len(ends) != 2 or not all(ends):
            raise ValueError(f"bad edge: {v}")
        out["|".join(sorted(ends))] = None
    return list(out)


def ranges(values: list, most: int = 1000) -> list[tuple[float, float]]:
    """Ranges (low, high) with 0 <= low < high < 1."""
    if not isinstance(values, list) or len(values) > most:
        raise ValueError(f"at most {most} ranges are allowed")
    out = []
    for r in values:
        low, high = (float(r["min"]), float(r["max"])) if isinstance(r, dict) else map(float, r)
        if not (math.isfinite(low) and math.isfinite(high) and 0 <= low < high < 1):
            raise ValueError(f"bad range: {r}")
        out.append((low, high))
    return out


def groups(values: list[dict], most: int = 100, longest: int = 16) -> list[tuple[str, list[str]]]:
    """Groups of accessions with distinct names, cases alike."""
    if not isinstance(values, list) or not values or len(values) > most:
        raise ValueError(f"one to {most} groups are needed")
    out, seen = [], set()
    for g in values:
        name = str(g.get("name", "")).strip()
        if not name or len(name) > longest or not GROUP.fullmatch(name):
            raise ValueError(f"bad group name: {name}")
        if name.lower() in seen:
            raise ValueError(f"group {name} occurs twice")
        seen.add(name.lower())
        own = g.get("accessions", "")
        parts = split_input(own) if isinstance(own, str) else [str(x) for x in own]
        clean = list(dict.fromkeys(x for x in (re.sub("[^A-Za-z0-9]", "", p) for p in parts) if x))
        if not clean:
            raise ValueError(f"group {name} has no accession")
        out.append((name, clean))
    return out


def strings(values, most: int) -> list[str]:
    if not isinstance(values, list) or not values or len(values) > most or not all(isinstance(v, str) and v.strip() for v in values):
        raise ValueError(f"a list of one to {most} texts is needed")
    return values
