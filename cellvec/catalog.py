"""Features, land-use classes and archetypes as data.

Fixed values: keys, labels, groups and tag values must equal the published ones. A user adds a
feature by one more row; ``Feature.rule`` may hold any predicate over the column ``tags``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.scalars import has_tag, is_tall, tag_in


@dataclass(frozen=True)
class Feature:
    key: str
    label: str
    grp: str
    source: str
    tag: str | None = None
    values: tuple[str, ...] = ()
    rule: Callable[[], Column] | None = None

    def matches(self) -> Column:
        own = F.col("source") == self.source
        if self.rule is not None:
            return own & self.rule()
        if self.tag is None:
            return own
        return own & (tag_in(self.tag, self.values) if self.values else has_tag(self.tag))


# Key, label, group, source, and the tag with its values (none: any value; no tag: every row).
POINT_FEATURES = [
    Feature("bars_pubs", "Bars & pubs", "Nightlife", "amenity", "amenity", ("bar", "pub", "biergarten")),
    Feature("nightclubs", "Nightclubs & music venues", "Nightlife", "amenity", "amenity", ("nightclub", "casino", "stripclub", "music_venue", "events_venue")),
    Feature("liquor_stores", "Liquor & wine stores", "Nightlife", "shop", "shop", ("alcohol", "wine")),
    Feature("restaurants", "Restaurants", "Food & Drink", "amenity", "amenity", ("restaurant",)),
    Feature("cafes", "Cafes", "Food & Drink", "amenity", "amenity", ("cafe",)),
    Feature("fast_food", "Fast food & ice cream", "Food & Drink", "amenity", "amenity", ("fast_food", "ice_cream")),
    Feature("bakeries_delis", "Bakeries & delis", "Food & Drink", "shop", "shop", ("bakery", "deli", "butcher", "cheese", "pastry", "confectionery", "coffee", "tea")),
    Feature("museums_galleries", "Museums & galleries", "Culture", "tlo", "tourism", ("museum", "gallery")),
    Feature("theatres_cinemas", "Theatres & cinemas", "Culture", "amenity", "amenity", ("theatre", "cinema", "arts_centre")),
    Feature("libraries", "Libraries", "Culture", "amenity", "amenity", ("library",)),
    Feature("bookshops", "Bookshops", "Culture", "shop", "shop", ("books",)),
    Feature("places_of_worship", "Places of worship", "Culture", "amenity", "amenity", ("place_of_worship",)),
    Feature("public_art", "Public art", "Culture", "tlo", "tourism", ("artwork",)),
    Feature("attractions", "Tourist attractions", "Culture", "tlo", "tourism", ("attraction", "viewpoint")),
    Feature("hotels", "Hotels & hostels", "Culture", "tlo", "tourism", ("hotel", "hostel", "guest_house", "motel", "apartment")),
    Feature("shops_total", "All shops", "Retail", "shop", "shop"),
    Feature("grocery", "Grocery & convenience", "Retail", "shop", "shop", ("supermarket", "convenience", "greengrocer", "general", "grocery")),
    Feature("fashion", "Fashion & boutiques", "Retail", "shop", "shop", ("clothes", "shoes", "jewelry", "boutique", "fashion_accessories", "bag", "watches")),
    Feature("personal_care", "Salons & personal care", "Retail", "shop", "shop", ("hairdresser", "beauty", "massage", "tattoo", "cosmetics", "nail_salon")),
    Feature("laundry_repair", "Laundry & repair shops", "Retail", "shop", "shop", ("laundry", "dry_cleaning", "hardware", "doityourself", "car_repair", "mobile_phone", "variety_store")),
    Feature("schools", "Schools & childcare", "Civic", "amenity", "amenity", ("school", "kindergarten", "childcare")),
    Feature("higher_ed", "Colleges & universities", "Civic", "amenity", "amenity", ("university", "college")),
    Feature("healthcare", "Healthcare", "Civic", "amenity", "amenity", ("hospital", "doctors", "clinic", "dentist", "pharmacy")),
    Feature("banks_atms", "Banks & ATMs", "Civic", "amenity", "amenity", ("bank", "atm")),
    Feature("public_safety", "Police & fire", "Civic", "amenity", "amenity", ("police", "fire_station", "post_office")),
    Feature("community", "Community & social services", "Civic", "amenity", "amenity", ("community_centre", "social_facility", "marketplace", "veterinary")),
    Feature("rail_stations", "Rail & subway stations", "Transit", "transit", "railway", ("station", "halt")),
    Feature("subway_entrances", "Subway entrances", "Transit", "transit", "railway", ("subway_entrance",)),
    Feature("tram_stops", "Tram stops", "Transit", "transit", "railway", ("tram_stop",)),
    Feature("bus_stops", "Bus stops", "Transit", "transit", "highway", ("bus_stop",)),
    Feature("bike_infra", "Bike parking & rental", "Transit", "amenity", "amenity", ("bicycle_parking", "bicycle_rental")),
    Feature("car_parking", "Car parking", "Transit", "amenity", "amenity", ("parking",)),
    Feature("fuel_charging", "Fuel & EV charging", "Transit", "amenity", "amenity", ("fuel", "charging_station", "car_wash")),
    Feature("major_roads", "Major road segments", "Streets", "streets", "highway", ("motorway", "trunk", "primary", "secondary", "tertiary")),
    Feature("local_streets", "Local street segments", "Streets", "streets", "highway", ("residential", "unclassified", "living_street")),
    Feature("pedestrian_paths", "Pedestrian paths", "Streets", "streets", "highway", ("pedestrian", "footway", "steps", "path")),
    Feature("cycleways", "Cycleways", "Streets", "streets", "highway", ("cycleway",)),
    Feature("service_roads", "Service roads & driveways", "Streets", "streets", "highway", ("service",)),
    Feature("buildings", "Buildings", "Built Form", "buildings", "building"),
    Feature("tall_buildings", "Tall buildings (6+ floors / 20m+)", "Built Form", "buildings", rule=is_tall),
    Feature("houses", "Single-family houses", "Built Form", "buildings", "building", ("house", "detached", "semidetached_house", "terrace", "bungalow", "semi")),
    Feature("apartments", "Apartment buildings", "Built Form", "buildings", "building", ("apartments", "residential", "dormitory")),
    Feature("offices", "Offices", "Built Form", "tlo", "office"),
    Feature("coworking", "Coworking spaces", "Built Form", "amenity", "amenity", ("coworking_space",)),
    Feature("parks", "Parks", "Nature", "tlo", "leisure", ("park", "nature_reserve")),
    Feature("gardens_playgrounds", "Gardens & playgrounds", "Nature", "tlo", "leisure", ("garden", "playground", "dog_park")),
    Feature("sports", "Sports facilities", "Nature", "tlo", "leisure", ("pitch", "sports_centre", "fitness_centre", "swimming_pool", "golf_course", "track", "stadium")),
    Feature("trees", "Mapped trees", "Nature", "trees"),
]
KEYS = [f.key for f in POINT_FEATURES]
STREET_KEYS = [f.key for f in POINT_FEATURES if f.grp == "Streets"]
#: Area features and their groups.
AREA_CLASSES = {"residential": "Built Form", "commercial": "Built Form", "industrial": "Built Form", "green": "Nature", "water": "Nature", "beach": "Nature"}

# Land-use classes in match order.
LAND_USE = {
    "residential": {"landuse": ["residential"]},
    "commercial": {"landuse": ["commercial", "retail"]},
    "industrial": {"landuse": ["industrial", "railway", "military", "brownfield", "construction"]},
    "green": {
        "landuse": ["grass", "forest", "meadow", "cemetery", "farmland", "recreation_ground", "orchard", "vineyard", "allotments", "village_green"],
        "leisure": ["park", "garden", "golf_course", "nature_reserve", "pitch", "playground", "dog_park"],
        "natural": ["wood", "scrub", "wetland", "heath", "grassland"],
    },
    "water": {"natural": ["water", "bay"]},
    "beach": {"natural": ["beach", "sand"]},
    "airport": {"aeroway": ["aerodrome"]},
}

# Archetypes; a term is a weight with a group or with keys of which the mean counts.
ARCHETYPES = {
    "The Core": [(1.0, "Nightlife"), (1.0, "Food & Drink"), (1.0, "Culture"), (1.5, ("tall_buildings", "offices", "hotels"))],
    "The Ring": [(0.9, "Food & Drink"), (0.9, "Retail"), (0.9, ("apartments", "subway_entrances", "rail_stations")), (-0.8, ("tall_buildings", "hotels", "attractions"))],
    "The Meadows": [(1.5, ("green_frac", "houses", "trees", "parks")), (-1.0, "Nightlife"), (-1.0, "Retail")],
    "The Bends": [(1.0, ("residential_frac", "schools", "places_of_worship", "grocery", "bus_stops")), (-0.7, ("tall_buildings", "offices", "hotels", "green_frac"))],
    "The Works": [(1.4, ("industrial_frac", "service_roads", "car_parking", "fuel_charging")), (-1.0, ("residential_frac",))],
    "The Shore": [(2.0, ("water_frac", "beach_frac")), (-0.5, ("buildings",))],
    "The Commons": [(1.4, ("higher_ed", "healthcare", "libraries", "community", "sports"))],
    "The Strip": [(1.2, ("major_roads", "fast_food", "car_parking", "shops_total", "fuel_charging")), (-0.5, ("pedestrian_paths",))],
    "The Quiet Grid": [(1.0, ("local_streets", "houses", "residential_frac")), (-1.0, "Food & Drink"), (-1.0, "Nightlife")],
    "The Edge": [(-1.0, "Food & Drink"), (-1.0, "Retail"), (-1.0, "Civic"), (-1.0, ("buildings",))],
}
