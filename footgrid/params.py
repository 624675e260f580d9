"""Parameter tables. Fixed values throughout: they must equal what the published model uses."""

from __future__ import annotations

# Aerial classes: (buffer_m, cover, extend_m, conf); defaults where a class has none of its own.
DEFAULT_BUFFER, DEFAULT_COVER, DEFAULT_EXTEND, DEFAULT_CONF = 10.0, 0.30, 0.0, 0.2
CLASS_RULES = {
    "Bushaltestelle": (25.0, 0.10, 0.0, 0.7),
    "Fussgaengerstreifen": (0.1, 0.30, 0.0, 0.5),
    "Fussgängerstreifen mit Insel": (0.1, 0.30, 0.0, 0.5),
    "Fussgängerstreifen ohne Insel": (0.1, 0.30, 0.0, 0.5),
    "Auto": (10.0, 0.10, 0.0, 0.85),
    "30er-Zone-Markierung": (10.0, 0.10, 0.0, 0.2),
    "30Zone": (10.0, 0.20, 0.0, 0.2),
    "Pfeil": (20.0, 0.20, 0.0, 0.2),
    "Schule": (0.0, 0.20, 0.0, 0.2),
    "Stopp-Markierung": (3.0, 0.20, 0.0, 0.2),
    "Vortritt": (5.0, 0.20, 0.0, 0.2),
    "Velo-Markierung": (3.0, 0.10, 0.0, 0.2),
    "Veloweg": (6.0, 0.10, 0.0, 0.2),
    "Tram": (12.0, 0.10, 7.0, 0.75),
    "Tramgleis": (12.0, 0.10, 7.0, 0.75),
    "Zug": (15.0, 0.10, 16.0, 0.75),
}

# Heat maps: metres a pixel, radius, and (min_conf, min_effort) by group.
PIXEL_M, HEAT_RADIUS_M, DEFAULT_MIN_CONF, DEFAULT_MIN_EFFORT = 2.0, 15.0, 0.2, 2
HEAT_GROUPS = {
    "Associated with bike": (0.3, 2), "Arrow": (0.2, 1), "Bridge": (0.1, 2), "CCTV Camera": (0.3, 2), "Construction Parking": (0.2, 2),
    "Construction Road (other)": (0.2, 2), "Crosswalk": (0.2, 2), "Dashed Marking": (0.2, 2), "Human Person": (0.2, 2), "Marking Other": (0.2, 2),
    "Nature": (0.2, 2), "Other": (0.2, 2), "Pedestrian Area": (0.2, 2), "Roads & Surfaces": (0.2, 2), "Sign other": (0.2, 1), "Stop Line": (0.2, 1),
    "Street Light": (0.3, 2), "Traffic Island": (0.2, 2), "Traffic Lights": (0.4, 2), "Traffic Signs": (0.3, 2), "Tram/Rail": (0.4, 2),
    "Tunnel": (0.2, 2), "Vehicles on the Road (motorized)": (0.3, 1), "Unmapped": (0.2, 2),
}

# Detection names by group; any other name is UNMAPPED.
UNMAPPED = "Unmapped"
GROUP_NAMES = {
    "Associated with bike": ("marking--discrete--symbol--bicycle", "object--vehicle--bicycle", "construction--flat--bike-lane", "human--rider--bicyclist", "object--traffic-light--cyclists"),
    "Arrow": ("marking--discrete--arrow--left", "marking--discrete--arrow--other", "marking--discrete--arrow--right", "marking--discrete--arrow--split-left-or-straight", "marking--discrete--arrow--split-right-or-straight", "marking--discrete--arrow--straight"),
    "Bridge": ("construction--structure--bridge",),
    "CCTV Camera": ("object--cctv-camera",),
    "Construction Parking": ("object--traffic-sign--information-parking", "construction--flat--parking-aisle", "object--parking-meter", "construction--flat--parking"),
    "Construction Road (other)": ("object--junction-box", "construction--barrier--concrete-block", "construction--barrier--curb", "construction--barrier--fence", "construction--barrier--guard-rail", "construction--barrier--temporary", "construction--barrier--road-side", "construction--barrier--road-median", "object--support--pole-group"),
    "Crosswalk": ("marking--discrete--crosswalk-zebra", "construction--flat--crosswalk-plain"),
    "Dashed Marking": ("marking--continuous--dashed",),
    "Human Person": ("human--person--person-group", "human--person--individual"),
    "Marking Other": ("marking--discrete--give-way-row", "marking--continuous--zigzag", "marking--continuous--solid", "marking--discrete--hatched--chevron", "marking--discrete--hatched--diagonal", "marking--discrete--other-marking"),
    "Nature": ("nature--vegetation", "object--bench", "object--bike-rack"),
    "Other": ("object--traffic-cone", "construction--structure--building", "object--manhole", "object--fire-hydrant", "marking--discrete--text"),
    "Pedestrian Area": ("construction--flat--pedestrian-area",),
    "Roads & Surfaces": ("construction--flat--road", "construction--flat--road-shoulder", "construction--flat--service-lane", "construction--flat--sidewalk", "construction--barrier--separator", "construction--barrier--wall", "construction--flat--driveway", "construction--flat--curb-cut"),
    "Sign other": ("object--sign--back", "object--sign--information", "object--sign--other", "object--traffic-sign--back", "object--traffic-light--other"),
    "Stop Line": ("marking--discrete--stop-line",),
    "Street Light": ("object--street-light",),
    "Traffic Island": ("construction--flat--traffic-island",),
    "Traffic Lights": ("object--traffic-light--general-upright", "object--traffic-light--pedestrians", "object--traffic-light--general-single", "object--traffic-light--general-horizontal"),
    "Traffic Signs": ("object--traffic-sign--temporary-back", "object--traffic-sign--front", "object--traffic-sign--temporary-front", "object--traffic-sign--direction-back", "object--traffic-sign--direction-front", "object--traffic-sign--ambiguous", "object--support--traffic-sign-frame"),
    "Tram/Rail": ("construction--flat--rail-track",),
    "Tunnel": ("construction--structure--tunnel",),
    "Vehicles on the Road (motorized)": ("human--rider--motorcyclist", "object--vehicle--other-vehicle", "object--vehicle--bus", "object--vehicle--car", "object--vehicle--motorcycle", "object--vehicle--trailer", "object--vehicle--truck", "object--vehicle--vehicle-group", "object--vehicle--wheeled-slow", "object--vehicle--on-rails"),
}
NAME_TO_GROUP = {name: group for group, names in GROUP_NAMES.items() for name in names}

# Geolocation.
Z_OFFSETS = {"very near": 5.0, "near": 7.5, "medium": 20.0, "far": 50.0, "very far": 100.0}
EXCLUDED_Z = ("far", "very far")
EXCLUDED_LABELS = (0, 1, 59, 60, 61, 62, 63, 65, 66, 69, 73, 76, 78, 79, 83, 85, 88, 104, 106, 109, 117, 118, 119, 120, 121, 122)
IMAGE_WIDTH, FIELD_OF_VIEW, DEPTH_INVALID, BLUR_LIMIT = 1024, 90.0, 9999.0, 100.0

# Network.
HIGHWAY_KEEP = ("footway", "path", "pedestrian", "steps", "living_street", "corridor", "platform")
ACCESS_KEEP = ("agricultural", "destination", "no", "permissive", "yes")
NEAREST_MAX_M, STUB_MIN_M, STUB_ROUNDS = 10.0, 50.0, 2
ROAD_TYPES = ("10m Strasse", "4m Strasse", "6m Strasse", "8m Strasse")
GROUND_TRUTH_BUFFER_M, ZONAL_BUFFER_M = 2.5, 12.0

# Scores.
ML_WEIGHTS = {"Geeignet": 100.0, "erhöhte Anforderung": 20.0, "anspruchsvoll": 10.0, "nicht empfohlen": 1.0}
LOW_SCORE, SIGMOID_SHIFT, SIGMOID_SCALE, RISK_EXPONENT = 20.0, 5.0, 0.5, 1.2
RAST = 0.25
RISK_WEIGHTS = {
    "crossing_without_marking": 3.0, "crossing_without_pedestrian": 1.2, "crossing_with_tram": 3.0, "crossing_with_tram_without_pedestrian": 6.0,
    "crossing_with_tram_has_island_and_marked": 1.2, "auto": 0.4, "tram": 1.0, "tramgleis": 1.0, "bushaltestelle": 0.3, "deg_u_norm": 0.1,
    "deg_v_norm": 0.1, "30zone": -0.5, "30er_zone_markierung": -0.2, "fussgaengerstreifen": -0.5, "fussgaengerstreifen_mit_insel": -0.8,
    "stopp_markierung": -0.3, "veloweg": 0.5, "velo_markierung": 0.3, "vortritt": 0.1, "rast_crosswalk": -0.2 * RAST,
    "rast_traffic_lights": -0.2 * RAST, "rast_traffic_island": -0.1 * RAST, "rast_tram_rail": 0.4 * RAST,
    "rast_vehicles_on_the_road_motorized": 0.5 * RAST, "rast_dashed_marking": 0.3 * RAST, "rast_stop_line": -0.1 * RAST, "rast_street_light": -0.05 * RAST,
}
GATE_WEIGHTS = {"tram": 2.0, "tramgleis": 1.2, "rast_tram_rail": 0.6 * RAST}

# Routing cases: (alpha, beta, label).
ROUTE_CASES = ((1.0, 0.0, "Fastest"), (1.0, 1.0, "Balanced"), (1.0, 3.0, "Safe"), (0.0, 1.0, "Safest"))
BATCH_CASES = ((1.0, 0.0, "Fastest"), (1.0, 1.0, "Balanced"), (1.0, 3.0, "Safest"), (0.0, 1.0, "Absolute Safest"))

# Aerial tiles: seconds a tile, start-up seconds, share for joining results.
TILE_SECONDS, STARTUP_SECONDS, POST_SHARE = 0.20, 5.0, 0.03
