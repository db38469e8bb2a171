"""Configurations: the registry of datasets with their sources, and what a run of the pipeline reads. All checked on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


def _text(entry: Mapping, key: str, default: str = "") -> str:
    return str(entry.get(key) or default).strip()


def logical_sources(raw: Sequence | None, where: str) -> dict[str, list[str]]:
    """Source to members of a list of {source_id, members}, checked; none gives none."""
    if raw is None:
        return {}
    if not isinstance(raw, list) or not raw:
        raise ValueError(f"sources of {where} must be a list that is not empty")
    out: dict[str, list[str]] = {}
    for entry in raw:
        name = _text(entry, "source_id") if isinstance(entry, Mapping) else ""
        members = entry.get("members") if isinstance(entry, Mapping) else None
        if not name or not isinstance(members, list) or not members:
            raise ValueError(f"a source of {where} needs an id and members: {entry!r}")
        clean = [str(m).strip() for m in members]
        if name in out or not all(clean) or len(set(clean)) != len(clean):
            raise ValueError(f"source {name} of {where} is repeated, or a member is blank or repeated")
        out[name] = clean
    return out


@dataclass(frozen=True)
class Dataset:
    dataset_id: str
    root_path: str
    product_path: str
    label: str
    default_start_date: str = ""
    source_mode: str = "subdirs"
    discovery_mode: str = "static"
    source_ids: tuple[str, ...] = ()
    sources: dict[str, list[str]] = field(default_factory=dict)
    sort_order: int = 0


def registry(raw: Sequence | Mapping) -> list[Dataset]:
    """The datasets of a registry (a list, or an object with one), in its order."""
    entries = raw.get("datasets") if isinstance(raw, Mapping) else raw
    if not isinstance(entries, list) or not entries:
        raise ValueError("the registry of datasets is empty")
    out: list[Dataset] = []
    for n, e in enumerate(entries):
        if not isinstance(e, Mapping):
            raise ValueError(f"not a dataset: {e!r}")
        name, root, product = (_text(e, k) for k in ("dataset_id", "root_path", "product_path"))
        if not (name and root and product):
            raise ValueError(f"a dataset needs dataset_id, root_path and product_path: {e!r}")
        if any(d.dataset_id == name for d in out):
            raise ValueError(f"dataset {name} is repeated")
        ids = e.get("source_ids")
        if ids is not None and (not isinstance(ids, list) or e.get("sources") is not None):
            raise ValueError(f"dataset {name} has sources or a list of source_ids, not both")
        label = _text(e, "label", name.replace("_", " ").title())
        modes = (_text(e, "default_start_date"), _text(e, "source_mode", "subdirs"), _text(e, "discovery_mode", "static"))
        clean = tuple(s for s in (str(i).strip() for i in ids or ()) if s)
        out.append(Dataset(name, root, product, label, *modes, clean, logical_sources(e.get("sources"), name), n))
    return out


KINDS = ("csv", "csv_tree", "captures")


def pipeline_inputs(config: Mapping) -> list[Mapping]:
    """The inputs of a pipeline's configuration, checked."""
    inputs = config.get("inputs") if isinstance(config, Mapping) else None
    if not isinstance(inputs, list) or not inputs:
        raise ValueError("the configuration must have a list of inputs")
    for spec in inputs:
        if spec.get("kind") not in KINDS:
            raise ValueError(f"an input is one of {', '.join(KINDS)}: {spec!r}")
        if not spec.get("path"):
            raise ValueError(f"an input needs a path: {spec!r}")
        if spec["kind"] != "captures" and not isinstance(spec.get("mapping"), Mapping):
            raise ValueError(f"a CSV input needs a mapping: {spec!r}")
    sources = [s for spec in inputs for s in logical_sources(spec.get("sources"), spec["path"])]
    if len(set(sources)) != len(sources):
        raise ValueError("two inputs define the same logical source")
    return inputs
