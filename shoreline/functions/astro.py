"""Astronomical arguments and nodal corrections of tide constituents, from the published series for the mean longitudes of moon and sun
and the usual truncated nodal expansions (Schureman 1940, Pugh 1987).

All angles are in degrees. Times are epoch seconds, UTC.
"""

from __future__ import annotations

import numpy as np

#: Constituent -> multiples of (solar hour angle from midnight, s, h, p, perihelion) and a constant.
NUMBERS = {
    "2N2": (2, -4, 2, 2, 0, 0), "Eps2": (2, -5, 4, 1, 0, 0), "J1": (1, 1, 1, -1, 0, 90), "K1": (1, 0, 1, 0, 0, 90), "K2": (2, 0, 2, 0, 0, 0),
    "L2": (2, -1, 2, -1, 0, 180), "Lambda2": (2, -1, 0, 1, 0, 180), "M2": (2, -2, 2, 0, 0, 0), "M3": (3, -3, 3, 0, 0, 0), "M4": (4, -4, 4, 0, 0, 0),
    "M6": (6, -6, 6, 0, 0, 0), "M8": (8, -8, 8, 0, 0, 0), "MKS2": (2, -2, 4, 0, 0, 0), "MN4": (4, -5, 4, 1, 0, 0), "MS4": (4, -2, 2, 0, 0, 0),
    "MSf": (0, 2, -2, 0, 0, 0), "Mf": (0, 2, 0, 0, 0, 0), "Mm": (0, 1, 0, -1, 0, 0), "Msqm": (0, 4, -2, 0, 0, 0), "Mtm": (0, 3, 0, -1, 0, 0),
    "Mu2": (2, -4, 4, 0, 0, 0), "N2": (2, -3, 2, 1, 0, 0), "N4": (4, -6, 4, 2, 0, 0), "Nu2": (2, -3, 4, -1, 0, 0), "O1": (1, -2, 1, 0, 0, -90),
    "P1": (1, 0, -1, 0, 0, -90), "Q1": (1, -3, 1, 1, 0, -90), "R2": (2, 0, 1, 0, -1, 180), "S1": (1, 0, 0, 0, 0, 180), "S2": (2, 0, 0, 0, 0, 0),
    "S4": (4, 0, 0, 0, 0, 0), "Sa": (0, 0, 1, 0, 0, 0), "Ssa": (0, 0, 2, 0, 0, 0), "T2": (2, 0, -1, 0, 1, 0),
}
#: Degrees an hour of the same five angles.
RATES = (15.0, 0.54901652, 0.04106864, 0.00464183, 0.00000196)


def speed(name: str) -> float:
    return sum(k * r for k, r in zip(NUMBERS[name], RATES, strict=False))


def longitudes(t: np.ndarray) -> tuple[np.ndarray, ...]:
    """Mean longitudes of moon, sun, lunar perigee, lunar node and perihelion."""
    c = (np.asarray(t, float) + 2_209_032_000.0) / (36525 * 86400.0)  # Julian centuries since noon of the last day of 1899
    s = 270.43659 + 481267.89057 * c + 0.00198 * c * c
    h = 279.69660 + 36000.76892 * c + 0.00030 * c * c
    p = 334.32956 + 4069.03403 * c - 0.01032 * c * c
    n = 259.18328 - 1934.14201 * c + 0.00208 * c * c
    q = 281.22083 + 1.71902 * c + 0.00045 * c * c
    return s, h, p, n, q


def equilibrium(names: list[str], t: np.ndarray) -> np.ndarray:
    """Equilibrium arguments, names x times."""
    t = np.asarray(t, float)
    s, h, p, _, q = longitudes(t)
    hour = 15.0 * ((t / 3600.0) % 24.0)
    k = np.array([NUMBERS[x] for x in names], float).reshape(-1, 6)
    return k @ np.stack([hour, s, h, p, q, np.ones_like(t)])


def nodal(names: list[str], t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors and angles of the nodal corrections, names x times."""
    _, _, p, n, _ = longitudes(t)
    n, p = np.radians(n), np.radians(p)
    one, none = np.ones_like(n), np.zeros_like(n)

    def polar(x, y):
        return np.hypot(x, y), np.degrees(np.arctan2(y, x))

    m2 = polar(1 - 0.03731 * np.cos(n) + 0.00052 * np.cos(2 * n), -0.03731 * np.sin(n) + 0.00052 * np.sin(2 * n))
    k1 = polar(1 + 0.1158 * np.cos(n) - 0.0029 * np.cos(2 * n), -0.1554 * np.sin(n) + 0.0029 * np.sin(2 * n))
    k2 = polar(1 + 0.2852 * np.cos(n) + 0.0324 * np.cos(2 * n), -0.3108 * np.sin(n) - 0.0324 * np.sin(2 * n))
    o1 = np.hypot(1 + 0.189 * np.cos(n) - 0.0058 * np.cos(2 * n), 0.189 * np.sin(n) - 0.0058 * np.sin(2 * n)), 10.8 * np.sin(n) - 1.3 * np.sin(2 * n) + 0.2 * np.sin(3 * n)
    j1 = polar(1 + 0.169 * np.cos(n), -0.227 * np.sin(n))
    l2 = polar(1 - 0.25 * np.cos(2 * p) - 0.11 * np.cos(2 * p - n) - 0.04 * np.cos(n), -0.25 * np.sin(2 * p) - 0.11 * np.sin(2 * p - n) - 0.04 * np.sin(n))
    mf = 1.043 + 0.414 * np.cos(n), -23.7 * np.sin(n) + 2.7 * np.sin(2 * n) - 0.4 * np.sin(3 * n)
    power = lambda a, k: (a[0] ** k, a[1] * k)
    known = {"K1": k1, "K2": k2, "O1": o1, "Q1": o1, "J1": j1, "L2": l2, "Mf": mf, "Mtm": mf, "Msqm": mf, "Mm": (1 - 0.130 * np.cos(n), none), "M3": power(m2, 1.5), "M4": power(m2, 2), "MN4": power(m2, 2), "N4": power(m2, 2), "M6": power(m2, 3), "M8": power(m2, 4), "MKS2": (m2[0] * k2[0], m2[1] + k2[1])}
    known |= {x: m2 for x in ("M2", "N2", "2N2", "Mu2", "Nu2", "Lambda2", "Eps2", "MS4", "MSf")}
    f, u = zip(*(known.get(x, (one, none)) for x in names), strict=True)
    return np.stack(f), np.stack(u)
