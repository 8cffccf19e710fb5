"""Relations found at any depth of JSON documents, as rows."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.web import FORWARD_KEYS

#: Keys under which an object names its target.
TARGET_KEYS = ("@id", "id", "href", "url", "iri")


def _targets(value: object) -> Iterator[str]:
    if isinstance(value, str):
        if value.strip():
            yield value.strip()
    elif isinstance(value, list):
        for v in value:
            yield from _targets(v)
    elif isinstance(value, dict):
        named = next((value[k] for k in TARGET_KEYS if isinstance(value.get(k), str) and value[k].strip()), None)
        if named:
            yield named.strip()


def _walk(node: object, key: str) -> Iterator[str]:
    """Targets of every member whose name, lower-cased and with ``:`` as ``_``, ends in ``key``."""
    stack = [node]
    while stack:
        at = stack.pop()
        if isinstance(at, dict):
            for name, value in at.items():
                if name.lower().replace(":", "_").endswith(key):
                    yield from _targets(value)
            stack.extend(reversed(list(at.values())))
        elif isinstance(at, list):
            stack.extend(reversed(at))


def relations_of(text: str | None, keys: Sequence[str] = FORWARD_KEYS) -> list[tuple[str, str]]:
    """(relation, url) by priority of the relations, each url once. Unreadable JSON has none."""
    try:
        node = json.loads(text or "")
    except ValueError:
        return []
    found: dict[str, str] = {}
    for key in keys:
        for url in _walk(node, key):
            found.setdefault(url, key)
    return [(r, u) for u, r in found.items()]


def walk_relations(df: DataFrame, json_col: str) -> DataFrame:
    """One row per relation: the other columns, ord, relation, url."""
    names = [c for c in df.columns if c != json_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ords, kinds, urls = [], [], [], []
            for i, v in enumerate(batch[json_col]):
                for n, (relation, url) in enumerate(relations_of(v.as_py())):
                    rows.append(i)
                    ords.append(n)
                    kinds.append(relation)
                    urls.append(url)
            kept = batch.select(names).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(ords, pa.int32()), pa.array(kinds, pa.string()), pa.array(urls, pa.string())], [*names, "ord", "relation", "url"]
            )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in names)
    return df.mapInArrow(run, f"{fields}ord int, relation string, url string")
