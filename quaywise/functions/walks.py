"""Tree walks over JSON payloads, in Arrow batches: geometries with their paths, location objects, text blobs,
deep merge patches. Used once at publish time; queries read the tables they fill."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEEPEST = 32
KEYS = ("geo", "gps", "polygon")


NUMBERS = (int, float)  # of a value read from JSON: a truth value is none


def _position(x, y) -> bool:
    return type(x) in NUMBERS and type(y) in NUMBERS and -180 <= x <= 180 and -90 <= y <= 90


def _geojson(value) -> tuple[str, list] | None:
    """A range-checked point, or the outer ring of a polygon with four positions or more."""
    if not isinstance(value, dict):
        return None
    at = value.get("coordinates")
    if value.get("type") == "Point" and isinstance(at, list) and len(at) >= 2:
        return ("Point", [(float(at[0]), float(at[1]))]) if _position(at[0], at[1]) else None
    if value.get("type") == "Polygon" and isinstance(at, list) and at:
        return _ring(at[0])
    return None


def _ring(at) -> tuple[str, list] | None:
    if not isinstance(at, list) or len(at) < 4:
        return None
    ring = []
    for p in at:
        if type(p) is not list or len(p) < 2 or not _position(p[0], p[1]):
            return None
        ring.append((float(p[0]), float(p[1])))
    return "Polygon", ring


def _gps(value) -> tuple[str, list] | None:
    if not isinstance(value, str) or value.count(",") != 1:
        return None
    try:
        lat, lon = map(float, value.split(","))
    except ValueError:
        return None
    return ("Point", [(lon, lat)]) if _position(lon, lat) else None


#: Geometry readers by member name.
PARSERS: dict[str, Callable] = {"geo": _geojson, "gps": _gps, "polygon": _ring}


def geometries(value) -> list[tuple[str, str, list]]:
    """(path with ``[*]`` for lists, kind, ring) depth first, in document order."""
    found: list[tuple[str, str, list]] = []
    _add_geometries(value, "$", 0, found)
    return found


def _add_geometries(value, path: str, depth: int, found: list) -> None:
    if depth > DEEPEST:
        return
    if type(value) is dict:
        for k, v in value.items():
            if k in PARSERS:
                shape = PARSERS[k](v)
                if shape:
                    found.append((f"{path}.{k}", *shape))
            elif type(v) is dict or type(v) is list:
                _add_geometries(v, f"{path}.{k}", depth + 1, found)
    elif type(value) is list:
        path += "[*]"
        for v in value:
            if type(v) is dict or type(v) is list:
                _add_geometries(v, path, depth + 1, found)


def geo_objects(value, path: str = "$", depth: int = 0) -> Iterator[tuple[str, str]]:
    """(path, whole location object as JSON): the walk stops at the object that holds a geometry."""
    if depth > DEEPEST:
        return
    if isinstance(value, dict):
        if any(k in value and PARSERS[k](value[k]) for k in KEYS):
            yield path, json.dumps(value, sort_keys=True)
            return
        for k, v in value.items():
            yield from geo_objects(v, f"{path}.{k}", depth + 1)
    elif isinstance(value, list):
        for v in value:
            yield from geo_objects(v, f"{path}[*]", depth + 1)


_decoder = json.JSONDecoder()


def _loaded(text: str | None):
    if text is None:
        return None
    try:
        value, end = _decoder.raw_decode(text)
        return value if end == len(text) else _decoder.decode(text)
    except RecursionError:
        return None
    except ValueError:
        pass
    try:
        return _decoder.decode(text)  # white space before it
    except ValueError:
        return None


WEB = ("http://", "https://")


def all_texts(value, parts: dict[str, None]) -> None:
    """Adds every text (no address of the web) and number of a JSON value to ``parts``, in document order, and the names
    of members that are true; context members and shapes are passed over."""
    kind = type(value)
    if kind is dict:
        for k, v in value.items():
            if k in PARSERS or k[:1] == "@":
                continue
            # texts, the most frequent, are added here: a call for each would cost more than the rest
            if type(v) is str:
                if v and not v.isspace() and not v.startswith(WEB):
                    parts[v] = None
            elif v is True:
                parts[k] = None
            else:
                all_texts(v, parts)
    elif kind is list:
        for v in value:
            all_texts(v, parts)
    elif kind is str:
        if value and not value.isspace() and not value.startswith(WEB):
            parts[value] = None
    elif kind in NUMBERS:
        parts[str(value)] = None


def location_texts(value, parts: dict[str, None]) -> None:
    """The texts beside the shapes of locations, wherever they are."""
    if type(value) is dict:
        if "geo" in value or "gps" in value or "polygon" in value:
            for k, v in value.items():
                if k not in PARSERS and k[:1] != "@":
                    all_texts(v, parts)
            return
        value = value.values()
    for v in value:
        if type(v) is dict or type(v) is list:
            location_texts(v, parts)


def text_parts(resource: str | None, offers: Iterable[str | None]) -> str | None:
    """The searched text of a resource and its offers, all JSON texts; null where the resource is no object."""
    r = _loaded(resource)
    if type(r) is not dict:
        return None
    descriptor = _at(r, ("descriptor",))
    named = (_at(descriptor, ("name",)), _at(descriptor, ("shortDesc",)), _at(descriptor, ("longDesc",)), _at(r, ("category", "name")), _at(r, ("provider", "descriptor", "name")))
    parts: dict[str, None] = {n: None for n in named if type(n) is str and n and not n.isspace()}
    location_texts(r, parts)
    for value in (r.get("resourceAttributes"), r.get("constraints"), r.get("policies"), _at(descriptor, ("docs",)), _at(descriptor, ("mediaFile",))):
        if value is not None:
            all_texts(value, parts)
    for offer in offers:
        all_texts(_loaded(offer), parts)
    return " ".join(parts)


def _at(value, path: tuple[str, ...]):
    for name in path:
        value = value.get(name) if isinstance(value, dict) else None
    return value


def extract_geometries(items: DataFrame, keys: list[str], payload: Column) -> DataFrame:
    """``keys, path, pos, geometry``: one row per geometry in the payload."""
    xy = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    source = items.select(*keys, F.to_json(payload).alias("_p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # columns are filled flat: a batch holds no object for each shape and corner
            rows, paths, places, kinds, ends, xs, ys = [], [], [], [], [0], [], []
            for row, text in enumerate(batch.column(len(keys)).to_pylist()):
                for n, (path, kind, ring) in enumerate(geometries(_loaded(text))):
                    rows.append(row)
                    paths.append(path)
                    places.append(n)
                    kinds.append(kind)
                    for x, y in ring:
                        xs.append(x)
                        ys.append(y)
                    ends.append(len(xs))
            corners = pa.StructArray.from_arrays([pa.array(xs, pa.float64()), pa.array(ys, pa.float64())], fields=list(xy))
            shape = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), corners)], names=["kind", "ring"])
            own = batch.select(range(len(keys))).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(paths, pa.string()), pa.array(places, pa.int32()), shape], names=[*keys, "path", "pos", "geometry"])

    schema = ", ".join(f"`{c}` {t}" for c, t in source.select(*keys).dtypes)
    return source.mapInArrow(run, f"{schema}, path string, pos int, geometry struct<kind:string,ring:array<struct<x:double,y:double>>>")


def extract_geo_objects(items: DataFrame, keys: list[str], payload: Column) -> DataFrame:
    """``keys, path, pos, location``: one row per location object in the payload, whole and as JSON text."""
    kind = pa.list_(pa.struct([("path", pa.string()), ("pos", pa.int32()), ("location", pa.string())]))
    source = items.select(*keys, F.to_json(payload).alias("_p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"path": p, "pos": n, "location": o} for n, (p, o) in enumerate(geo_objects(_loaded(t)))] for t in batch.column("_p").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=[*keys, "_g"])

    schema = ", ".join(f"`{c}` {t}" for c, t in source.select(*keys).dtypes)
    rows = source.mapInArrow(run, f"{schema}, _g array<struct<path:string,pos:int,location:string>>")
    return rows.select(*keys, F.explode("_g").alias("_g")).select(*keys, "_g.*")


def deep_merge_patch(target, patch):
    """The whole of a merge patch: objects merge at every level, null deletes, anything else replaces."""
    if type(patch) is not dict:
        return patch
    out = dict(target) if type(target) is dict else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = deep_merge_patch(out.get(k), v) if type(v) is dict else v
    return out


def without_nulls(value):
    """A JSON object without null members at any depth of objects; what stands in lists stays as it is."""
    if not isinstance(value, dict):
        return value
    return {k: without_nulls(v) for k, v in value.items() if v is not None}


def with_offer(payload, patch):
    """A payload with an offer merged into the one of its first catalogue that has the same id, or appended to them."""
    offers = _first_catalog(payload).setdefault("offers", [])
    for n, offer in enumerate(offers):
        if isinstance(offer, dict) and offer.get("id") == patch.get("id"):
            offers[n] = deep_merge_patch(offer, patch)
            return payload
    offers.append(patch)
    return payload


def with_resource(payload, patch):
    """A payload with a patch merged into the first resource of its first catalogue; without one it stays as it is."""
    resources = _first_catalog(payload).get("resources") or []
    if resources and patch is not None:
        resources[0] = deep_merge_patch(resources[0], patch)
    return payload


def _first_catalog(payload) -> dict:
    catalogs = payload.setdefault("catalogs", [{}])
    if not catalogs:
        catalogs.append({})
    return catalogs[0]


#: Ways to merge a patch into a payload, by name.
MERGES: dict[str, Callable] = {
    "value": deep_merge_patch,
    "offer": with_offer,
    "resource": with_resource,
    "offer without nulls": lambda payload, patch: with_offer(payload, without_nulls(patch)),
}


def patched(rows: DataFrame, target: str, patch: str, out: str, how: str = "value") -> DataFrame:
    """``out``: the JSON text ``target`` with the JSON text ``patch`` merged in (one of :data:`MERGES`); null where either is
    no JSON."""
    return patched_in_turn(rows.withColumn("_how", F.lit(how)), target, [(patch, "_how")], out).drop("_how")


def patched_in_turn(rows: DataFrame, target: str, patches: list[tuple[str, str]], out: str) -> DataFrame:
    """As :func:`patched`, with several patches one after the other, each a column with the patch and one with the way to merge
    it: a row is read and written as JSON once, and rows merged in different ways go through together."""

    def merged(target: str | None, pairs: list[tuple[str | None, str]]) -> str | None:
        value = _loaded(target)
        for text, how in pairs:
            patch = _loaded(text)
            if value is None or patch is None:
                return None
            value = MERGES[how](value, patch)
        return json.dumps(value, sort_keys=True, ensure_ascii=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(*(zip(batch.column(p).to_pylist(), batch.column(h).to_pylist(), strict=True) for p, h in patches), strict=True)
            found = [merged(t, p) for t, p in zip(batch.column(target).to_pylist(), pairs, strict=True)]
            yield batch.append_column(out, pa.array(found, pa.string()))

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, `{out}` string")


def patched_members(rows: DataFrame, offers: str, resource: str, patches: list[tuple[str, str]]) -> DataFrame:
    """The offers (a list of JSON texts) and the first resource (a JSON text) of a payload with patches merged in, one after the
    other, as :func:`patched_in_turn` leaves them in it; null where a patch is no JSON. A patch whose way is null is left out;
    ``value`` patches no member. The columns of the patches are dropped.

    The payload's other members, which such patches do not change, need not be put together; an offer is read only
    while the one that a patch names is looked for, and what no patch met keeps its text.
    """
    keys = [c for c in rows.columns if c not in {offers, resource, *(c for pair in patches for c in pair)}]
    encode = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode

    def merged(own: list, main: str | None, pairs: Iterable[tuple[str | None, str | None]], read: Callable):
        """The first resource, or its text where no patch met it; changes the list of offers. Whether all patches are JSON."""
        for text, how in pairs:
            if how is None:
                continue
            patch = read(text)
            if patch is None:
                return None, False
            if how == "resource":
                main = None if main is None else deep_merge_patch(_read(main), patch)
            else:
                _merge_offer(own, without_nulls(patch) if how == "offer without nulls" else patch)
        return main, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lru_cache(4096)(_loaded)  # many rows may share a patch; what is merged is copied, so it stays as it is
        for batch in batches:
            column = lambda c: c.to_numpy(zero_copy_only=False).tolist()  # noqa: E731  several times as fast as to_pylist
            lists = batch.column(offers)
            texts, sizes = column(lists.flatten()), column(pc.fill_null(lists.value_lengths(), 0))
            pairs = zip(*(zip(column(batch.column(p)), column(batch.column(h)), strict=True) for p, h in patches), strict=True)
            at, ends, broken, out, mains = 0, [0], [], [], []  # filled flat: no object is kept for a row
            for size, main, pair in zip(sizes, column(batch.column(resource)), pairs, strict=True):
                own = texts[at : at + size]
                at += size
                main, good = merged(own, main, pair, read)
                if good:
                    out += [o if o is None or type(o) is str else encode(o) for o in own]
                broken.append(not good)
                ends.append(len(out))
                mains.append(main if main is None or type(main) is str else encode(main))
            new = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.string()), mask=pa.array(broken, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, new, pa.array(mains, pa.string())], names=[*keys, offers, resource])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys).dtypes)
    return rows.mapInArrow(run, f"{schema}, `{offers}` array<string>, `{resource}` string")


def _read(value):
    """A member as it is after earlier patches, or read from its text."""
    return _loaded(value) if type(value) is str else value


def _merge_offer(offers: list, patch) -> None:
    key = patch.get("id")
    for n, text in enumerate(offers):
        if type(text) is str and type(key) is str and key not in text and "\\" not in text:
            continue  # without an escape, the id would stand in the text as it is
        offer = _read(text)
        if type(offer) is dict and offer.get("id") == key:
            offers[n] = deep_merge_patch(offer, patch)
            return
    offers.append(patch)
