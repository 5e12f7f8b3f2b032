"""Chart specifications: tolerant parsing, classification, canonical text, and the typed plan that is compiled."""

from __future__ import annotations

import ast
import json
import re
from dataclasses import dataclass, field
from typing import Any

#: Fixed values.
AGGREGATES = ("mean", "sum", "count", "median", "min", "max")
KINDS = ("line", "scatter", "bar", "histogram", "heatmap", "boxplot", "area", "multi-line", "grouped-bar", "pie", "step")
SPEC_KEYS = ("vega_spec", "vega_lite_spec", "vegalite_spec", "vega_lite_json", "vegalite_json", "spec")
CONTAINERS = ("hconcat", "vconcat", "concat")
COMPOSED = ("layer", *CONTAINERS, "facet")

FENCE = re.compile(r"```(?:json|vega-lite|vegalite|vega)?\s*([\s\S]*?)```", re.IGNORECASE)


class SpecError(ValueError):
    """A spec that can't be drawn."""


def is_chart_like(spec: Any) -> bool:
    """V2: a mark with encoding or data, any composition, or a schema with mark or encoding."""
    if not isinstance(spec, dict):
        return False
    has = spec.__contains__
    return (has("mark") and (has("encoding") or has("data"))) or any(map(has, COMPOSED)) or (has("$schema") and (has("mark") or has("encoding")))


def _attempt(read, text: str):
    """What `text` is read as, in a list, or an empty one: a failure only means that this isn't the notation."""
    try:
        return [read(text)]
    except Exception:  # noqa: BLE001
        return []


def _readings(text: str):
    """Every value that some part of the text may be read as: all of it, then from each bracket on, as JSON with anything behind it or as a literal up to the end."""
    yield from _attempt(json.loads, text)
    yield from _attempt(ast.literal_eval, text.strip())
    decoder = json.JSONDecoder()
    for opening in re.finditer(r"[{\[]", text):
        tail = text[opening.start() :]
        yield from _attempt(lambda t: decoder.raw_decode(t)[0], tail) or _attempt(ast.literal_eval, tail)


def parse_spec(value: Any, depth: int = 0) -> dict | None:
    """V1: the first chart-like object in a value, which may be a dict, JSON, a literal, fenced text or prose with either.

    An object that isn't one itself may have it as its `spec`, one level down. Text in JSON strings is read in turn.
    """
    if isinstance(value, dict):
        return next((x for x in (value, value.get("spec")) if is_chart_like(x)), None)
    if not isinstance(value, str) or not value.strip() or depth > 4:
        return None
    for text in (*(m.strip() for m in FENCE.findall(value)), value.strip()):
        for read in _readings(text):
            if isinstance(read, (dict, str)) and (found := parse_spec(read, depth + 1)) is not None:
                return found
    return None


def canonical(value: Any) -> Any:
    """V3: keys sorted at every depth; lists keep their order."""
    if isinstance(value, dict):
        return {k: canonical(value[k]) for k in sorted(value)}
    return [canonical(x) for x in value] if isinstance(value, list) else value


def canonical_text(spec: Any, compact: bool = False) -> str:
    """V4."""
    return json.dumps(canonical(spec), sort_keys=True, separators=(",", ":")) if compact else json.dumps(canonical(spec), sort_keys=True, indent=2)


def flatten(value: Any, path: str = "") -> dict[str, str]:
    """V8: path to JSON text of each leaf. Empty containers leave nothing; dots in keys aren't escaped."""
    if isinstance(value, dict):
        inner = [(f"{path}.{k}" if path else str(k), v) for k, v in value.items()]
    elif isinstance(value, list):
        inner = [(f"{path}[{i}]", v) for i, v in enumerate(value)]
    else:
        return {path: json.dumps(value, sort_keys=True)}
    out: dict[str, str] = {}
    for key, v in inner:
        out.update(flatten(v, key))
    return out


def mark_type(spec: dict) -> str | None:
    mark = spec.get("mark")
    return mark.get("type") if isinstance(mark, dict) else mark


def channel(spec: dict, name: str) -> dict:
    found = (spec.get("encoding") or {}).get(name)
    if isinstance(found, list):
        found = found[0] if found else None
    return found if isinstance(found, dict) else {}


def title_text(title: Any) -> str | None:
    """V7: plain text of a title in any of its notations."""
    if isinstance(title, dict):
        title = title.get("text")
    if isinstance(title, list):
        return " ".join(map(str, title))
    return None if title is None else str(title)


def label(ch: dict) -> str | None:
    """V7: explicit title, agg(field), count(), field."""
    if ch.get("title") is not None:
        return title_text(ch["title"])
    agg, name = ch.get("aggregate"), ch.get("field")
    return f"{agg}({name})" if agg and name else "count()" if agg == "count" else name


def kind_of(spec: dict) -> str | None:
    """V5: one of KINDS, or None."""
    for key in CONTAINERS:
        if key in spec:
            kinds = [kind_of(c) if isinstance(c, dict) else None for c in spec[key] or []]
            return kinds[0] if kinds and all(k in KINDS for k in kinds) else None
    if "layer" in spec:
        marks = [mark_type(x) for x in spec["layer"] if isinstance(x, dict)]
        if marks and set(marks) in ({"line"}, {"bar"}):
            return "multi-line" if marks[0] == "line" else "grouped-bar"
        mixed = {"point", "circle", "line", "bar", "area", "rule"}
        return "scatter" if marks and set(marks) - {None} <= mixed else None
    if isinstance(spec.get("spec"), dict) and not spec.get("mark"):
        return kind_of(spec["spec"])
    mark = mark_type(spec)
    encoding = spec.get("encoding") or {}
    grouped = channel(spec, "color").get("field") or "xOffset" in encoding or "yOffset" in encoding
    if mark == "line":
        shape = (spec["mark"].get("interpolate") if isinstance(spec["mark"], dict) else None) or ""
        return "step" if str(shape).startswith("step") else "multi-line" if channel(spec, "color").get("field") else "line"
    if mark == "bar":
        return "histogram" if channel(spec, "x").get("bin") or channel(spec, "y").get("bin") else "grouped-bar" if grouped else "bar"
    return {"point": "scatter", "circle": "scatter", "area": "area", "rect": "heatmap", "boxplot": "boxplot", "arc": "pie"}.get(mark)


def is_supported(spec: Any) -> bool:
    """V6."""
    if not isinstance(spec, dict):
        return False
    for key in CONTAINERS:
        if children := spec.get(key):
            return all(is_supported(c) for c in children)
    return kind_of(spec) in KINDS


# --- the typed plan ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Channel:
    field: str | None = None
    aggregate: str | None = None
    bin: bool = False
    maxbins: int | None = None
    title: str | None = None
    log: bool = False
    domain: tuple | None = None
    value: Any = None


@dataclass(frozen=True)
class Source:
    values: tuple | None = None
    name: str | None = None
    url: str | None = None


@dataclass
class Unit:
    source: Source
    transforms: list
    mark: str
    channels: dict[str, Channel]
    title: str | None = None


@dataclass
class Layer:
    children: list[Unit]


@dataclass
class Facet:
    direction: str
    field: str
    child: Unit


@dataclass
class Concat:
    children: list  # a SpecError in place of a child that has no plan
    rows: int
    columns: int


@dataclass
class Plan:
    root: Unit | Layer | Facet | Concat
    datasets: dict[str, list] = field(default_factory=dict)


def _channel(raw: dict) -> Channel:
    scale, bins = raw.get("scale") or {}, raw.get("bin")
    domain = scale.get("domain") if isinstance(scale, dict) else None
    most = bins.get("maxbins") if isinstance(bins, dict) else None
    return Channel(raw.get("field"), raw.get("aggregate"), bool(bins), most if isinstance(most, int) else None, label(raw), isinstance(scale, dict) and scale.get("type") == "log", tuple(domain) if isinstance(domain, list) and len(domain) == 2 else None, raw.get("value"))


def _source(spec: dict, inherited: Source) -> Source:
    data = spec.get("data")
    if not isinstance(data, dict):
        return inherited
    values = data.get("values")
    return Source(tuple(values) if isinstance(values, list) else None, data.get("name"), data.get("url"))


def _unit(spec: dict, inherited: Source) -> Unit:
    mark = mark_type(spec)
    if not mark:
        raise SpecError("no mark")
    raw = {name: channel(spec, name) for name in (spec.get("encoding") or {})}
    return Unit(_source(spec, inherited), list(spec.get("transform") or []), mark, {k: _channel(v) for k, v in raw.items() if v}, title_text(spec.get("title")))


def build(spec: dict, inherited: Source = Source()) -> Unit | Layer | Facet | Concat:
    """The plan of a spec. Layers inherit the data alone; children of a concatenation inherit nothing."""
    for key in CONTAINERS:
        children = spec.get(key)
        if isinstance(children, list) and len(children) >= 2:
            plans = [_child(c) for c in children]
            return Concat(plans, *((1, len(plans)) if key == "hconcat" else (len(plans), 1)))
    source = _source(spec, inherited)
    across = {d: channel(spec, d).get("field") for d in ("column", "row")}
    if any(across.values()):
        if all(across.values()):
            raise SpecError("facets in both directions")
        direction = "column" if across["column"] else "row"
        return Facet(direction, across[direction], _unit({**spec, "encoding": {k: v for k, v in spec["encoding"].items() if k not in across}}, source))
    if "facet" in spec:
        raise SpecError("a facet without a row or column channel")
    if layers := spec.get("layer"):
        return Layer([_unit(x, source) for x in layers])
    return _unit(spec, source)


def _child(spec: Any) -> Unit | Layer | Facet | Concat | SpecError:
    try:
        return build(spec)
    except SpecError as wrong:
        return wrong
    except (AttributeError, TypeError) as wrong:
        return SpecError(f"a panel that isn't a chart: {wrong}")


def plan(spec: Any) -> Plan:
    found = parse_spec(spec)
    if found is None:
        raise SpecError("not a chart specification")
    return Plan(build(found), dict(found.get("datasets") or {}))
