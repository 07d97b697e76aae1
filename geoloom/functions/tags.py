"""Tags: lookup, classification, predicates and contact columns, all as Catalyst expressions.

A feature's tags are ``map<string,string>``; ``tag_map`` builds it from
entries so that the first of repeated keys wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions import vocab

STRING = "string"


def tag_map(entries: Column) -> Column:
    """Map of array<struct<k,v>> entries; of repeated keys the first is kept."""
    keys = F.transform(entries, lambda e: e["k"])
    first = F.filter(entries, lambda e, i: F.array_position(keys, e["k"]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value"))))


def tag(tags: Column, key: str) -> Column:
    """Value of a key, null where absent."""
    return F.try_element_at(tags, F.lit(key))


def has_tag(tags: Column, key: str) -> Column:
    return F.map_contains_key(tags, key)


def literal_map(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def any_of(table: dict[str, str], layer: Column, cls: Column) -> Column:
    """Whether (layer, class) is in a vocabulary table."""
    whole, single = vocab.pairs(table)
    test = layer.isin(*sorted(whole)) if whole else F.lit(False)
    by: dict[str, list[str]] = {}
    for k, c in sorted(single):
        by.setdefault(k, []).append(c)
    return reduce(lambda a, b: a | b, ((layer == k) & cls.isin(*c) for k, c in by.items()), test)


def parse_layers(text: str | None) -> tuple[str, ...]:
    """Layers of a comma list; none, empty or ``all`` stands for all; an unknown name is an error."""
    names = [x.strip().lower() for x in (text or "all").split(",") if x.strip()]
    if not names or names == ["all"]:
        return vocab.LAYERS
    if names == ["none"]:
        return ()
    for n in names:
        if n not in vocab.LAYERS:
            raise ValueError(f"unknown layer: {n}")
    return tuple(n for n in vocab.LAYERS if n in names)


def _decided(value: Callable[[str], Column], present: Callable[[str], Column], layers: Iterable[str]) -> tuple[Column, Column]:
    """(layer, class) by the first key in order that is present and whose layer is enabled."""
    enabled = set(layers)
    layer, cls = F.lit(None).cast(STRING), F.lit(None).cast(STRING)
    for key in reversed([k for k in vocab.KEY_ORDER if vocab.LAYER_OF_KEY[k] in enabled]):
        found = F.coalesce(F.try_element_at(literal_map(vocab.class_of_value(key)), value(key)), F.lit("other"))
        own_layer, own_class = F.lit(vocab.LAYER_OF_KEY[key]), found
        if key == "natural":  # natural=water is a lake of the layer water
            water = value(key) == "water"
            own_layer, own_class = F.when(water, F.lit("water")).otherwise(F.lit("natural")), F.when(water, F.lit("lake")).otherwise(found)
        layer, cls = F.when(present(key), own_layer).otherwise(layer), F.when(present(key), own_class).otherwise(cls)
    return layer, cls


def classify(tags: Column, layers: Iterable[str] = vocab.LAYERS) -> tuple[Column, Column]:
    """(layer, class) of a tag map; both null if no enabled key is there."""
    return _decided(lambda k: tag(tags, k), lambda k: has_tag(tags, k), layers)


def classify_pair(k: Column, v: Column, layers: Iterable[str] = vocab.LAYERS) -> tuple[Column, Column]:
    """(layer, class) of a single key and value."""
    return _decided(lambda key: v, lambda key: k == key, layers)


def min_zoom(layer: Column, cls: Column) -> Column:
    """Smallest zoom at which a feature is drawn; 14 for anything unknown."""
    table = {f"{k}/{c}": z for k, zs in vocab.MIN_ZOOM.items() for c, z in zs.items()}
    at = literal_map(table)
    return F.coalesce(F.try_element_at(at, F.concat_ws("/", layer, cls)), F.try_element_at(at, F.concat(layer, F.lit("/"))), F.lit(14)).cast("int")


def contour_class(metres: Column) -> Column:
    return F.when(metres % 100 == 0, "major").when(metres % 50 == 0, "intermediate").otherwise("minor")


def is_area(layer: Column, cls: Column) -> Column:
    return F.coalesce(any_of(vocab.AREAS, layer, cls), F.lit(False))


def is_line(layer: Column, cls: Column) -> Column:
    return F.coalesce(any_of(vocab.LINES, layer, cls), F.lit(False))


class TagFilter:
    """A boolean algebra over tags that compiles to one Column."""

    def __init__(self, build: Callable[[Column], Column], text: str):
        self._build, self.text = build, text

    def __call__(self, tags: Column) -> Column:
        return self._build(tags)

    def __repr__(self) -> str:
        return f"TagFilter({self.text})"

    @staticmethod
    def equals(key: str, value: str) -> TagFilter:
        return TagFilter(lambda t: F.coalesce(tag(t, key) == value, F.lit(False)), f"{key}={value}")

    @staticmethod
    def exists(key: str) -> TagFilter:
        return TagFilter(lambda t: has_tag(t, key), f"{key}=*")

    @staticmethod
    def all_of(*parts: TagFilter) -> TagFilter:
        return TagFilter(lambda t: reduce(lambda a, b: a & b, (p(t) for p in parts), F.lit(True)), " & ".join(p.text for p in parts))

    @staticmethod
    def any_of(*parts: TagFilter) -> TagFilter:
        return TagFilter(lambda t: reduce(lambda a, b: a | b, (p(t) for p in parts), F.lit(False)), " | ".join(p.text for p in parts))

    def negated(self) -> TagFilter:
        return TagFilter(lambda t: ~self(t), f"!({self.text})")

    @staticmethod
    def parse(text: str) -> TagFilter:
        """Blank-separated tokens, any of which may match; ``k=*`` and ``k`` ask for the key; nothing matches all."""
        tokens = text.split()
        if not tokens:
            return TagFilter.all_of()
        parts = []
        for token in tokens:
            key, eq, value = token.partition("=")
            parts.append(TagFilter.exists(key) if not eq or value == "*" else TagFilter.equals(key, value))
        return parts[0] if len(parts) == 1 else TagFilter.any_of(*parts)


def include_exclude(tags: Column, include: str | None, exclude: str | None) -> Column:
    """Included and not excluded; blank texts are ignored."""
    wanted = TagFilter.parse(include)(tags) if include and include.strip() else F.lit(True)
    return wanted & ~TagFilter.parse(exclude)(tags) if exclude and exclude.strip() else wanted


def _full(tags: Column, key: str) -> Column:
    return F.nullif(tag(tags, key), F.lit(""))


def _first(tags: Column, *keys: str) -> Column:
    return F.coalesce(*(_full(tags, k) for k in keys), F.lit(""))


def phone(tags: Column) -> Column:
    return _first(tags, "phone", "contact:phone", "telephone")


def website(tags: Column) -> Column:
    return _first(tags, "website", "contact:website", "url")


def address(tags: Column) -> Column:
    """Street with its number, city, state and postcode; a number without a street is dropped."""
    street = F.when(_full(tags, "addr:street").isNotNull(), F.concat_ws(" ", _full(tags, "addr:housenumber"), _full(tags, "addr:street")))
    return F.concat_ws(", ", street, _full(tags, "addr:city"), _full(tags, "addr:state"), _full(tags, "addr:postcode"))


def address_parts(tags: Column) -> Column:
    """The ``addr:`` tags with values, keyed ``addr_...`` with blanks of the namespace as underscores."""
    own = F.map_filter(tags, lambda k, v: k.startswith("addr:") & (F.length(k) > 5) & (v != ""))
    return F.transform_keys(own, lambda k, v: F.concat(F.lit("addr_"), F.replace(F.substring(k, 6, 1_000_000), F.lit(":"), F.lit("_"))))


# Tags that have columns of their own.
OWN_COLUMNS = ("name", "phone", "telephone", "website", "url", "operator")


def other_tags(tags: Column) -> Column:
    """The rest as ``k=v; k=v``, sorted by key."""
    rest = F.map_filter(tags, lambda k, v: ~(k.isin(*OWN_COLUMNS) | k.startswith("addr:") | k.startswith("contact:")))
    return F.array_join(F.transform(F.array_sort(F.map_entries(rest)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")


def richness(address_: Column, phone_: Column, website_: Column, operator: Column, tags_text: Column) -> Column:
    """How much an entity tells: weighted contact columns and the bytes of the other tags."""
    full = lambda c: (F.coalesce(c, F.lit("")) != "").cast("int")
    return (3 * full(address_) + 2 * full(phone_) + 2 * full(website_) + full(operator) + F.octet_length(F.coalesce(tags_text, F.lit("")))).cast("long")


def category(layer: Column, cls: Column) -> Column:
    """Category code of the device format; layers without one count as trails."""
    code = vocab.CATEGORY_CODES
    return (
        F.when((layer == "highway") & cls.isin(*vocab.TRAIL_CLASSES), code["trail"]).when(layer == "highway", code["road"])
        .when((layer == "water") & cls.isin(*vocab.WATER_LINES), code["water_line"]).when(layer == "water", code["water_area"])
        .when((layer == "contour") & (cls == "major"), code["contour_major"]).when(layer == "contour", code["contour_minor"])
        .when(layer.isin("natural", "landuse", "leisure"), code["natural_area"]).when(layer == "boundary", code["boundary"]).otherwise(code["trail"])
    ).cast("int")


def subcategory(layer: Column, cls: Column) -> Column:
    return F.when(layer == "highway", F.coalesce(F.try_element_at(literal_map(vocab.SUBCATEGORY), cls), F.lit(3))).otherwise(0).cast("int")


def poi_type(layer: Column, cls: Column) -> Column:
    table = literal_map({f"{k}/{c}": v for (k, c), v in vocab.POI_TYPES.items()})
    return F.coalesce(F.try_element_at(table, F.concat_ws("/", layer, cls)), F.lit(vocab.POI_OTHER)).cast("int")


def type_byte(is_polygon: Column, category_: Column, subcategory_: Column) -> Column:
    """Polygon flag, category and subcategory in one byte (0-255)."""
    return (F.when(is_polygon, 128).otherwise(0) + category_ % 8 * 16 + subcategory_ % 16).cast("int")


def trail_relevant(layer: Column, cls: Column, tags: Column | None = None) -> Column:
    """On a device map; footways tagged as sidewalk or crossing are not."""
    shown = F.coalesce(any_of(vocab.TRAIL, layer, cls), F.lit(False))
    if tags is None:
        return shown
    walk = (layer == "highway") & (cls == "footway") & F.coalesce(tag(tags, "footway").isin("sidewalk", "crossing"), F.lit(False))
    return shown & ~walk


def is_poi(layer: Column, cls: Column) -> Column:
    return F.coalesce(any_of(vocab.POINTS, layer, cls), F.lit(False))


def is_labelled(layer: Column, cls: Column) -> Column:
    return F.coalesce(any_of(vocab.LABELLED, layer, cls), F.lit(False))
