"""Named sites and the closed seas."""

#: The sites offered by name, as longitude and latitude.
PRESETS = {
    "Changjiang Estuary": (122.00, 31.00),
    "Pearl River Estuary": (113.75, 22.35),
    "Hangzhou Bay": (121.20, 30.50),
    "Bohai Bay": (118.00, 38.80),
    "Victoria Harbour": (114.17, 22.29),
    "Jiaozhou Bay": (120.25, 36.10),
    "Tokyo Bay": (139.80, 35.50),
    "Singapore Strait": (103.85, 1.25),
    "Rotterdam": (4.10, 51.95),
    "New York Harbor": (-74.05, 40.65),
    "San Francisco Bay": (-122.42, 37.82),
    "Sydney Harbour": (151.25, -33.85),
    "Amazon River Mouth": (-49.50, 0.50),
}
#: Vertices (longitude, latitude) of the Mediterranean, closed.
MEDITERRANEAN = [
    (-5.6, 35.85), (-5.6, 36.18), (-4.0, 36.8), (-2.0, 36.8), (-0.5, 38.5), (0.5, 40.5), (3.2, 42.4), (3.5, 43.5),
    (5.5, 43.4), (7.5, 43.7), (9.5, 44.4), (12.5, 45.6), (13.8, 45.8), (15.0, 44.5), (19.5, 42.0), (20.0, 39.5),
    (23.0, 38.0), (24.0, 41.0), (26.5, 41.0), (29.5, 41.2), (29.0, 40.5), (27.0, 40.0), (28.0, 37.0), (31.0, 36.8),
    (34.5, 36.8), (36.2, 36.0), (36.2, 33.5), (35.0, 31.5), (32.5, 31.3), (30.0, 31.3), (25.0, 31.6), (20.0, 30.0),
    (15.0, 30.2), (11.5, 33.0), (11.0, 37.5), (8.5, 37.0), (3.0, 36.8), (-2.0, 35.2), (-5.6, 35.85),
]
#: Vertices of the Black Sea with the Sea of Azov, closed.
BLACK_SEA = [
    (27.2, 41.5), (27.5, 42.5), (28.5, 44.0), (29.8, 45.3), (30.7, 46.5), (31.5, 46.6), (33.5, 46.0), (35.0, 45.4),
    (35.0, 47.3), (39.3, 47.3), (39.0, 45.5), (36.6, 45.2), (38.0, 44.5), (40.0, 43.5), (41.7, 42.0), (41.3, 41.4),
    (39.7, 41.0), (36.3, 41.3), (35.0, 42.0), (32.0, 41.8), (29.1, 41.2), (28.0, 41.3), (27.2, 41.5),
]
CLOSED_SEAS = {"mediterranean": MEDITERRANEAN, "black_sea": BLACK_SEA}
