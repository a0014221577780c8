"""Vocabularies, prompts and previews: small files that the driver reads."""

from __future__ import annotations

import csv
import itertools
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from foliant.functions import plain
from foliant.functions import scalar as S


def _scalar(text: str) -> str:
    text = text.split(" #", 1)[0].strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def read_yaml(text: str) -> dict[str, list[str] | dict[str, str] | str]:
    """Keys with lists, with maps of scalars, or with scalars: the part of YAML that vocabularies are written in; yes and no stay texts."""
    out: dict = {}
    key = None
    for line in text.splitlines():
        body = line.strip()
        if not body or body.startswith("#") or body == "---":
            continue
        if not line[:1].isspace() and not body.startswith("- "):
            key, _, value = body.partition(":")
            key = _scalar(key)
            out[key] = _scalar(value) if value.strip() else []
        elif body.startswith("- ") and key is not None and isinstance(out[key], list):
            out[key].append(_scalar(body[2:]))
        elif ":" in body and key is not None:
            k, _, v = body.partition(":")
            if not isinstance(out[key], dict):
                out[key] = {}
            out[key][_scalar(k)] = _scalar(v)
    return out


@dataclass
class Vocabulary:
    """SRC14, SET6: stop words are those known and the file's, the file's places overlay the map, its lists replace the lists of categories."""

    name_stopwords: set[str] = field(default_factory=lambda: set(S.NAME_STOPWORDS))
    place_stopwords: set[str] = field(default_factory=lambda: set(S.PLACE_STOPWORDS))
    place_map: dict[str, str] = field(default_factory=lambda: dict(S.PLACE_MAP))
    categories: dict[str, list[str]] = field(default_factory=lambda: {"detail_report_types": list(S.REPORT_TYPES), "crime_types": list(plain.CRIMES), "whether_abuse_values": list(plain.ABUSE), "conflict_types": list(S.CONFLICTS), "trial_types": list(plain.TRIALS)})

    @classmethod
    def read(cls, path: str | Path | None) -> Vocabulary:
        """A file that isn't there or can't be read leaves the defaults."""
        try:
            found = read_yaml(Path(path).read_text(encoding="utf-8")) if path else {}
        except (OSError, UnicodeDecodeError):
            found = {}
        out = cls()
        words = lambda k: {w.strip().lower() for w in found.get(k) or () if w.strip()} if isinstance(found.get(k), list) else set()
        out.name_stopwords |= words("name_stopwords")
        out.place_stopwords |= words("place_stopwords")
        if isinstance(found.get("place_map"), dict):
            out.place_map |= {k.strip().lower(): v.strip() for k, v in found["place_map"].items() if k.strip() and v.strip()}
        for k in out.categories:
            if isinstance(found.get(k), list):
                once = {w.strip().casefold(): w.strip() for w in reversed(found[k]) if w.strip()}
                out.categories[k] = list(reversed(once.values())) or out.categories[k]
        return out


def prompt(folder: str | Path, *parts: str, legacy: Iterable[str] = (), fallback: str = "") -> str:
    """SRC15: the text of folder/parts, else of the first legacy name that is there, else the fallback; stripped."""
    tries = [Path(folder).joinpath(*parts)] if parts else []
    found = next((p for p in [*tries, *(Path(folder) / n for n in legacy)] if p.exists()), None)
    return (found.read_text(encoding="utf-8") if found else fallback).strip()


def preview(path: str | Path, limit: int = 100) -> list[dict[str, str]]:
    """SRC16: the first rows of a CSV; none if it isn't there."""
    if not Path(path).exists():
        return []
    with Path(path).open(encoding="utf-8", newline="") as f:
        return list(itertools.islice(csv.DictReader(f), limit))


def counted_preview(path: str | Path, limit: int = 8) -> dict:
    """SRC16: headers, the first rows, how many there are, and whether more follow."""
    if not Path(path).exists():
        return {"exists": False, "headers": [], "rows": [], "row_count": 0, "preview_truncated": False}
    with Path(path).open(encoding="utf-8-sig", newline="") as f:
        reader = csv.DictReader(f)
        rows = list(itertools.islice(reader, limit))
        n = len(rows) + sum(1 for _ in reader)
    return {"exists": True, "headers": list(reader.fieldnames or []), "rows": [{k: v or "" for k, v in r.items() if k} for r in rows], "row_count": n, "preview_truncated": n > len(rows)}
