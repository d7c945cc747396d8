"""Sinks for small evidence files: canonical bytes, written once, published whole."""

from __future__ import annotations

import hashlib
import json
import os
import secrets
import time
from pathlib import Path

from pyspark.sql import DataFrame


def canonical_json(payload: object, newline: bool = True) -> bytes:
    """Sorted keys, no spaces, ASCII, no NaN or infinity."""
    return (json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False) + "\n" * newline).encode("ascii")


def parse_unique(text: str) -> object:
    """JSON in which an object may not repeat a key."""

    def unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key is repeated")
        return dict(pairs)

    return json.loads(text, object_pairs_hook=unique)


def publish(path: str | Path, data: bytes, replace: bool = False) -> str:
    """Writes beside the target, then links it into place: readers see all of it or nothing. Returns the digest.

    Without `replace` an existing file stays: equal bytes are accepted, others are an error.
    """
    path = Path(path)
    digest = hashlib.sha256(data).hexdigest()
    part = path.with_name(f".{path.name}.{secrets.token_hex(8)}")
    part.write_bytes(data)
    try:
        if replace:
            os.replace(part, path)
        else:
            try:
                os.link(part, path)
            except FileExistsError:
                if path.read_bytes() != data:
                    raise ValueError(f"{path} exists with other content") from None
    finally:
        part.unlink(missing_ok=True)
    return digest


def write_rows(df: DataFrame, path: str | Path, replace: bool = False) -> str:
    """A small result as one canonical JSON array, rows in order."""
    rows = sorted((json.loads(r) for r in df.toJSON().collect()), key=lambda r: json.dumps(r, sort_keys=True))
    return publish(path, canonical_json(rows), replace)


def append_event(folder: str | Path, component: str, event: str, payload: dict) -> Path:
    """One journal event as its own file, never overwritten."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"{component}-{time.time_ns()}-{secrets.token_hex(6)}.json"
    publish(path, canonical_json({"component": component, "event": event, "recorded_at_ns": time.time_ns(), "payload": payload}))
    return path


def tex_table(df: DataFrame, columns: list[str], caption: str) -> str:
    """A small result as a TeX table; commands in the text are escaped."""
    def cell(v: object) -> str:
        if isinstance(v, float):
            return f"{v:.4f}"
        out = str(v).replace("\\", r"\textbackslash{}")
        for x in "&%$#_":
            out = out.replace(x, "\\" + x)
        return out

    lines = [" & ".join(map(cell, row)) + r" \\" for row in df.select(*columns).collect()]
    return "\n".join([rf"\caption{{{cell(caption)}}}", r"\begin{tabular}{" + "l" * len(columns) + "}", " & ".join(map(cell, columns)) + r" \\ \hline", *lines, r"\end{tabular}", ""])
