"""Vocabulary of map features: fixed values, and the lookups built from them."""

from __future__ import annotations

# Classes by layer, in order; "a=b" makes b a synonym of class a.
CLASSES: dict[str, str] = {
    "amenity": "parking school place_of_worship restaurant fuel hospital pharmacy bank cafe fast_food pub bar police fire_station post_office library university kindergarten marketplace",
    "shop": "supermarket convenience clothes hairdresser car_repair bakery beauty car mobile_phone hardware butcher alcohol furniture electronics department_store mall bicycle books jewelry gift florist pet sports optician",
    "tourism": "hotel motel attraction museum viewpoint information guest_house camp_site picnic_site theme_park zoo hostel artwork",
    "office": "company government insurance lawyer estate_agent financial it ngo accountant architect",
    "healthcare": "doctor dentist clinic hospital pharmacy optometrist physiotherapist laboratory rehabilitation",
    "craft": "carpenter electrician plumber painter brewery photographer tailor hvac shoemaker gardener locksmith roofer",
    "historic": "monument memorial castle ruins archaeological_site fort battlefield building",
    "club": "sport social veterans music gaming fishing",
    "emergency": "ambulance_station fire_station=fire_hydrant hospital phone defibrillator assembly_point",
    "education": "school university college kindergarten language_school driving_school music_school",
    "leisure": "park garden playground golf_course sports_centre swimming_pool stadium pitch nature_reserve marina",
    "highway": "motorway motorway_link trunk trunk_link primary primary_link secondary secondary_link tertiary tertiary_link residential unclassified service living_street pedestrian track bus_guideway footway bridleway steps corridor path cycleway trailhead",
    "railway": "rail subway tram light_rail monorail narrow_gauge preserved disused abandoned platform station",
    "waterway": "river stream canal drain ditch",
    "water": "lake pond reservoir basin river",
    "natural": "water wood scrub grassland heath sand bare_rock wetland glacier beach cliff peak volcano saddle=col tree coastline",
    "landuse": "residential commercial industrial retail farmland=farm=farmyard forest grass meadow orchard vineyard cemetery military quarry recreation_ground",
    "building": "yes house apartments commercial industrial retail garage garages shed hut cabin church cathedral mosque temple synagogue hospital school university kindergarten hotel office",
    "boundary": "administrative national_park protected_area maritime",
    "place": "city town village hamlet suburb neighbourhood isolated_dwelling",
}
# Keys in the order in which they decide; both water keys give the layer water.
KEY_ORDER = tuple(CLASSES)
LAYER_OF_KEY = {k: "water" if k == "waterway" else k for k in KEY_ORDER}
LAYERS = tuple(dict.fromkeys(LAYER_OF_KEY.values()))

# Smallest zoom by layer (the default under "") and class.
MIN_ZOOM: dict[str, dict[str, int]] = {
    "highway": {"": 14, "motorway": 4, "motorway_link": 4, "trunk": 5, "primary": 7, "secondary": 9, "tertiary": 11, "residential": 12, "unclassified": 12, "living_street": 12, "service": 13, "pedestrian": 13},
    "building": {"": 13},
    "water": {"": 13, "coastline": 0, "lake": 6, "reservoir": 6, "river": 8, "pond": 10, "basin": 10, "stream": 12, "canal": 12},
    "landuse": {"": 7},
    "natural": {"": 10, "coastline": 0, "water": 6, "wood": 6, "glacier": 6},
    "railway": {"": 12, "rail": 8, "subway": 10, "light_rail": 10},
    "amenity": {"": 13},
    "emergency": {"": 13},
    "education": {"": 13},
    "shop": {"": 14},
    "office": {"": 14},
    "healthcare": {"": 14},
    "craft": {"": 14},
    "club": {"": 14},
    "tourism": {"": 14, "theme_park": 10, "zoo": 10, "hotel": 13, "museum": 13, "attraction": 13},
    "historic": {"": 13, "castle": 10, "fort": 10},
    "leisure": {"": 12, "park": 8, "nature_reserve": 8, "golf_course": 10, "stadium": 10},
    "boundary": {"": 2},
    "place": {"": 12, "city": 4, "town": 7, "village": 10},
    "contour": {"": 14, "major": 10, "intermediate": 12, "minor": 14},
}
# Areas and lines; "*" stands for every class.
AREAS = {
    "building": "*",
    "landuse": "*",
    "boundary": "*",
    "leisure": "park garden golf_course nature_reserve stadium pitch",
    "natural": "water wood scrub grassland heath sand bare_rock wetland glacier beach",
    "water": "lake pond reservoir basin",
    "amenity": "parking",
    "historic": "castle fort ruins",
    "tourism": "theme_park zoo camp_site",
}
LINES = {"highway": "*", "railway": "*", "water": "river stream canal drain ditch", "contour": "*"}

# Keys that are looked up often, in order.
WELL_KNOWN = (
    "highway building name waterway natural landuse railway amenity leisure boundary place shop tourism power aeroway surface maxspeed ref oneway bridge tunnel layer access service foot bicycle lanes lit admin_level water office healthcare craft historic club emergency education"
    " addr:street addr:housenumber addr:city addr:postcode phone contact:phone website contact:website opening_hours cuisine brand operator description"
).split()
# Tags that a tile carries beside class and name, in order.
TILE_TAGS = "addr:street addr:housenumber addr:city addr:postcode phone contact:phone website contact:website opening_hours cuisine brand operator description".split()

# What a device map shows, by layer.
TRAIL = {
    "highway": "path footway track bridleway cycleway steps trailhead motorway trunk primary secondary tertiary residential unclassified service",
    "water": "*",
    "natural": "peak volcano cliff saddle",
    "boundary": "national_park protected_area",
    "contour": "*",
    "place": "city town village hamlet",
    "tourism": "camp_site viewpoint picnic_site information",
    "amenity": "parking",
}
POINTS = {"natural": "peak volcano cliff saddle", "highway": "trailhead", "tourism": "camp_site viewpoint picnic_site information", "amenity": "parking", "place": "*"}
LABELLED = {"highway": "path track bridleway cycleway motorway trunk primary secondary tertiary"}
CATEGORY_CODES = {"trail": 0, "road": 1, "water_line": 2, "water_area": 3, "contour_minor": 4, "contour_major": 5, "natural_area": 6, "boundary": 7}
TRAIL_CLASSES = "path footway track bridleway cycleway steps".split()
WATER_LINES = "river stream canal drain ditch coastline".split()
SUBCATEGORY = {"path": 0, "footway": 1, "track": 2, "bridleway": 3, "cycleway": 4, "steps": 5, "motorway": 0, "trunk": 1, "primary": 1, "secondary": 2, "tertiary": 2}
POI_TYPES = {("natural", "peak"): 0, ("natural", "volcano"): 0, ("tourism", "camp_site"): 1, ("tourism", "viewpoint"): 2, ("highway", "trailhead"): 3, ("tourism", "picnic_site"): 5, ("amenity", "parking"): 6, ("place", "village"): 7, ("place", "hamlet"): 7, ("place", "town"): 8, ("place", "city"): 9}
POI_OTHER = 15


def class_of_value(key: str) -> dict[str, str]:
    """Class by tag value of one key."""
    groups = [entry.split("=") for entry in CLASSES[key].split()]
    return {value: group[0] for group in groups for value in group}


def pairs(table: dict[str, str]) -> tuple[set[str], set[tuple[str, str]]]:
    """(layers taken whole, single (layer, class) pairs) of a table with "*"."""
    return {k for k, v in table.items() if v == "*"}, {(k, c) for k, v in table.items() if v != "*" for c in v.split()}
