"""The deep-space part of SGP4 on NumPy arrays: pulls of the Sun and the Moon, and resonances.

After the published model (Spacetrack Report 3 and its 2006 revision).  One object holds the terms
of many element sets with periods of 225 minutes and more; nothing loops over them.  Secular
rates and resonances act on the mean elements before drag's are added, periodic terms after.
"""

from __future__ import annotations

import numpy as np

# Mean motions (rad/min) and eccentricities of the apparent Sun and the Moon, and their scale.
SUN = {"motion": 1.19459e-5, "eccentricity": 0.01675, "scale": 2.9864797e-6}
MOON = {"motion": 1.5835218e-4, "eccentricity": 0.05490, "scale": 4.7968065e-7}
#: The Earth's rotation, rad/min, and the step of the resonances' integrator, minutes.
ROTATION, STEP = 4.37526908801129966e-3, 720.0
# Geopotential terms of the half-day resonance by degree and order, and their phases.
Q22, Q31, Q33 = 1.7891679e-6, 2.1460748e-6, 2.2123015e-7
ROOT22, ROOT32, ROOT44, ROOT52, ROOT54 = 1.7891679e-6, 3.7393792e-7, 7.3636953e-9, 1.1428639e-7, 2.1765803e-9
PHASES_DAY = (0.13130908, 2.8843198, 0.37448087)
G22, G32, G44, G52, G54 = 5.7686396, 0.95240898, 1.8014998, 1.0508330, 4.4108898
NEAR_EQUATOR = 5.2359877e-2


def sidereal(jd: np.ndarray) -> np.ndarray:
    """Greenwich's sidereal angle (rad) by the series of 1982."""
    t = (jd - 2451545.0) / 36525.0
    seconds = -6.2e-6 * t**3 + 0.093104 * t * t + (876600.0 * 3600 + 8640184.812866) * t + 67310.54841
    return np.mod(np.radians(seconds / 240.0), 2 * np.pi)


def _poly(e: np.ndarray, *c: float) -> np.ndarray:
    return sum(x * e**i for i, x in enumerate(c))


class _Body:
    """Coefficients of one perturbing body's pull on the orbits."""

    def __init__(self, body: dict, geometry: tuple, o: DeepSpace):
        cos_g, sin_g, cos_i, sin_i, cos_h, sin_h = geometry
        self.body = body
        a1 = cos_g * cos_h + sin_g * cos_i * sin_h
        a3 = -sin_g * cos_h + cos_g * cos_i * sin_h
        a7 = -cos_g * sin_h + sin_g * cos_i * cos_h
        a9 = sin_g * sin_h + cos_g * cos_i * cos_h
        a8, a10 = sin_g * sin_i, cos_g * sin_i
        a2, a4 = o.ci * a7 + o.si * a8, o.ci * a9 + o.si * a10
        a5, a6 = -o.si * a7 + o.ci * a8, -o.si * a9 + o.ci * a10
        sw, cw, e2 = np.sin(o.arg0), np.cos(o.arg0), o.e0 * o.e0
        x1, x2, x3, x4 = a1 * cw + a2 * sw, a3 * cw + a4 * sw, -a1 * sw + a2 * cw, -a3 * sw + a4 * cw
        x5, x6, x7, x8 = a5 * sw, a6 * sw, a5 * cw, a6 * cw
        z31, z32, z33 = 12 * x1 * x1 - 3 * x3 * x3, 24 * x1 * x2 - 6 * x3 * x4, 12 * x2 * x2 - 3 * x4 * x4
        beta2 = 1 - e2
        double = lambda own, z3: 2 * (own + z3 * e2) + beta2 * z3
        z1 = double(3 * (a1 * a1 + a2 * a2), z31)
        z2 = double(6 * (a1 * a3 + a2 * a4), z32)
        z3 = double(3 * (a3 * a3 + a4 * a4), z33)
        z11 = -6 * a1 * a5 + e2 * (-24 * x1 * x7 - 6 * x3 * x5)
        z12 = -6 * (a1 * a6 + a3 * a5) + e2 * (-24 * (x2 * x7 + x1 * x8) - 6 * (x3 * x6 + x4 * x5))
        z13 = -6 * a3 * a6 + e2 * (-24 * x2 * x8 - 6 * x4 * x6)
        z21 = 6 * a2 * a5 + e2 * (24 * x1 * x5 - 6 * x3 * x7)
        z22 = 6 * (a4 * a5 + a2 * a6) + e2 * (24 * (x2 * x5 + x1 * x6) - 6 * (x4 * x7 + x3 * x8))
        z23 = 6 * a4 * a6 + e2 * (24 * x2 * x6 - 6 * x4 * x8)
        s3 = body["scale"] / o.n0
        s2, s4 = -0.5 * s3 / np.sqrt(beta2), s3 * np.sqrt(beta2)
        s1 = -15 * o.e0 * s4
        s5, s6, s7 = x1 * x3 + x2 * x4, x2 * x3 + x1 * x4, x2 * x4 - x1 * x3
        ecc = body["eccentricity"]
        # amplitudes of the periodic terms on eccentricity, inclination, mean anomaly, perigee and node
        self.on_e = 2 * s1 * s6, 2 * s1 * s7
        self.on_i = 2 * s2 * z12, 2 * s2 * (z13 - z11)
        self.on_m = -2 * s3 * z2, -2 * s3 * (z3 - z1), -2 * s3 * (-21 - 9 * e2) * ecc
        self.on_g = 2 * s4 * z32, 2 * s4 * (z33 - z31), -18 * s4 * ecc
        self.on_h = -2 * s2 * z22, -2 * s2 * (z23 - z21)
        # secular rates
        n = body["motion"]
        self.e_dot = s1 * n * s5
        self.i_dot = s2 * n * (z11 + z13)
        self.m_dot = -n * s3 * (z1 + z3 - 14 - 6 * e2)
        self.g_dot = s4 * n * (z31 + z33 - 6)
        flat = (o.inc0 < NEAR_EQUATOR) | (o.inc0 > np.pi - NEAR_EQUATOR)
        self.h_dot = np.where(flat, 0.0, -n * s2 * (z21 + z23))

    def periodic(self, anomaly: np.ndarray) -> tuple[np.ndarray, ...]:
        f = anomaly + 2 * self.body["eccentricity"] * np.sin(anomaly)
        sf = np.sin(f)
        f2, f3 = 0.5 * sf * sf - 0.25, -0.5 * sf * np.cos(f)
        two = lambda c: c[0] * f2 + c[1] * f3
        return two(self.on_e), two(self.on_i), two(self.on_m) + self.on_m[2] * sf, two(self.on_g) + self.on_g[2] * sf, two(self.on_h)


class DeepSpace:
    """Terms of element sets, all angles in radians and motions in rad/min: mean ones at epoch and their rates."""

    def __init__(self, jd, e0, arg0, inc0, node0, n0, m0, m_dot, arg_dot, node_dot, xke: float):
        self.e0, self.arg0, self.inc0, self.node0, self.n0, self.m0 = e0, arg0, inc0, node0, n0, m0
        self.arg_dot, self.xke = arg_dot, xke
        self.si, self.ci = np.sin(inc0), np.cos(inc0)
        sh, ch = np.sin(node0), np.cos(node0)
        day = jd - 2433281.5 + 18261.5
        node_moon = np.mod(4.5236020 - 9.2422029e-4 * day, 2 * np.pi)
        sm, cm = np.sin(node_moon), np.cos(node_moon)
        ci_moon = 0.91375164 - 0.03568096 * cm
        si_moon = np.sqrt(1 - ci_moon * ci_moon)
        sh_moon = 0.089683511 * sm / si_moon
        ch_moon = np.sqrt(1 - sh_moon * sh_moon)
        gamma = 5.8351514 + 0.0019443680 * day
        turn = np.arctan2(0.39785416 * sm / si_moon, ch_moon * cm + 0.91744867 * sh_moon * sm) + gamma - node_moon
        self.sun = _Body(SUN, (0.1945905, -0.98088458, 0.91744867, 0.39785416, ch, sh), self)
        self.moon = _Body(MOON, (np.cos(turn), np.sin(turn), ci_moon, si_moon, ch_moon * ch + sh_moon * sh, sh * ch_moon - ch * sh_moon), self)
        self.sun_at = np.mod(6.2565837 + 0.017201977 * day, 2 * np.pi)
        self.moon_at = np.mod(4.7199672 + 0.22997150 * day - gamma, 2 * np.pi)

        self.e_rate = self.sun.e_dot + self.moon.e_dot
        self.i_rate = self.sun.i_dot + self.moon.i_dot
        self.m_rate = self.sun.m_dot + self.moon.m_dot
        with np.errstate(all="ignore"):
            h = [np.where(self.si != 0, b.h_dot / self.si, b.h_dot if b is self.sun else 0.0) for b in (self.sun, self.moon)]
        self.h_rate = h[0] + h[1]
        self.g_rate = self.sun.g_dot - self.ci * h[0] + self.moon.g_dot - self.ci * h[1]
        self.theta0 = sidereal(jd)

        self.day = (n0 > 0.0034906585) & (n0 < 0.0052359877)
        self.half = (n0 >= 8.26e-3) & (n0 <= 9.24e-3) & (e0 >= 0.5)
        aonv = (n0 / xke) ** (2 / 3)
        self._daily(aonv)
        self._half_daily(aonv)
        self.lam0 = np.where(self.half, m0 + 2 * node0 - 2 * self.theta0, m0 + node0 + arg0 - self.theta0)
        self.lam0 = np.mod(self.lam0, 2 * np.pi)
        slow = m_dot + self.m_rate - n0
        self.drift = np.where(self.half, slow + 2 * (node_dot + self.h_rate - ROTATION), slow + arg_dot + node_dot - ROTATION + self.g_rate + self.h_rate)

    def _daily(self, aonv: np.ndarray) -> None:
        e2 = self.e0**2
        g200, g310, g300 = 1 + e2 * (-2.5 + 0.8125 * e2), 1 + 2 * e2, 1 + e2 * (-6 + 6.60937 * e2)
        f220 = 0.75 * (1 + self.ci) ** 2
        f311 = 0.9375 * self.si**2 * (1 + 3 * self.ci) - 0.75 * (1 + self.ci)
        f330 = 1.875 * (1 + self.ci) ** 3
        base = 3 * (self.n0 * aonv) ** 2
        self.pull_day = base * f311 * g310 * Q31 * aonv, 2 * base * f220 * g200 * Q22, 3 * base * f330 * g300 * Q33 * aonv

    def _half_daily(self, aonv: np.ndarray) -> None:
        e, s, c = self.e0, self.si, self.ci
        low, mid, high = e <= 0.65, e < 0.7, e > 0.715
        pick = lambda where, a, b: np.where(where, _poly(e, *a), _poly(e, *b))
        g201 = -0.306 - (e - 0.64) * 0.440
        # Eccentricity functions of the model, below and above its borders.
        g211 = pick(low, (3.616, -13.2470, 16.2900), (-72.099, 331.819, -508.738, 266.724))
        g310 = pick(low, (-19.302, 117.3900, -228.4190, 156.5910), (-346.844, 1582.851, -2415.925, 1246.113))
        g322 = pick(low, (-18.9068, 109.7927, -214.6334, 146.5816), (-342.585, 1554.908, -2366.899, 1215.972))
        g410 = pick(low, (-41.122, 242.6940, -471.0940, 313.9530), (-1052.797, 4758.686, -7193.992, 3651.957))
        g422 = pick(low, (-146.407, 841.8800, -1629.014, 1083.4350), (-3581.690, 16178.110, -24462.770, 12422.520))
        g520 = np.where(low, _poly(e, -532.114, 3017.977, -5740.032, 3708.2760), pick(high, (-5149.66, 29936.92, -54087.36, 31324.56), (1464.74, -4664.75, 3763.64)))
        g521 = pick(mid, (-822.71072, 4568.6173, -8491.4146, 5337.524), (-51752.104, 218913.95, -309468.16, 146349.42))
        g532 = pick(mid, (-853.66600, 4690.2500, -8624.7700, 5341.4), (-40023.880, 170470.89, -242699.48, 115605.82))
        g533 = pick(mid, (-919.22770, 4988.6100, -9064.7700, 5542.21), (-37995.780, 161616.52, -229838.20, 109377.94))
        s2, c2 = s * s, c * c
        f220, f221 = 0.75 * (1 + 2 * c + c2), 1.5 * s2
        f321, f322 = 1.875 * s * (1 - 2 * c - 3 * c2), -1.875 * s * (1 + 2 * c - 3 * c2)
        f441, f442 = 35 * s2 * f220, 39.3750 * s2 * s2
        f522 = 9.84375 * s * (s2 * (1 - 2 * c - 5 * c2) + 0.33333333 * (-2 + 4 * c + 6 * c2))
        f523 = s * (4.92187512 * s2 * (-2 - 4 * c + 10 * c2) + 6.56250012 * (1 + 2 * c - 3 * c2))
        f542 = 29.53125 * s * (2 - 8 * c + c2 * (-12 + 8 * c + 10 * c2))
        f543 = 29.53125 * s * (-2 - 8 * c + c2 * (12 + 8 * c - 10 * c2))
        k = 3 * (self.n0 * aonv) ** 2
        # amplitude, turns of the perigee, turns of the longitude and phase of each term
        self.pull_half = [
            (k * ROOT22 * f220 * g201, 2, 1, G22),
            (k * ROOT22 * f221 * g211, 0, 1, G22),
            (k * aonv * ROOT32 * f321 * g310, 1, 1, G32),
            (k * aonv * ROOT32 * f322 * g322, -1, 1, G32),
            (2 * k * aonv**2 * ROOT44 * f441 * g410, 2, 2, G44),
            (2 * k * aonv**2 * ROOT44 * f442 * g422, 0, 2, G44),
            (k * aonv**3 * ROOT52 * f522 * g520, 1, 1, G52),
            (k * aonv**3 * ROOT52 * f523 * g532, -1, 1, G52),
            (2 * k * aonv**3 * ROOT54 * f542 * g521, 1, 2, G54),
            (2 * k * aonv**3 * ROOT54 * f543 * g533, -1, 2, G54),
        ]

    def _pull(self, lam: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rates of the resonant longitude, of the motion, and of the motion's rate."""
        slope, bend = np.zeros_like(lam), np.zeros_like(lam)
        for i, (pull, phase) in enumerate(zip(self.pull_day, PHASES_DAY, strict=True), 1):
            slope += np.where(self.day, pull * np.sin(i * (lam - phase)), 0.0)
            bend += np.where(self.day, i * pull * np.cos(i * (lam - phase)), 0.0)
        perigee = self.arg0 + self.arg_dot * at
        for pull, w, k, phase in self.pull_half:
            angle = w * perigee + k * lam - phase
            slope += np.where(self.half, pull * np.sin(angle), 0.0)
            bend += np.where(self.half, k * pull * np.cos(angle), 0.0)
        speed = n + self.drift
        return speed, slope, bend * speed

    def secular(self, t, node, arg, m) -> tuple[np.ndarray, ...]:
        """(e, inclination, node, perigee, anomaly, motion) after ``t`` minutes, of angles that already have the Earth's rates."""
        e, inc = self.e0 + self.e_rate * t, self.inc0 + self.i_rate * t
        arg, node, m = arg + self.g_rate * t, node + self.h_rate * t, m + self.m_rate * t
        n = self.n0.copy()
        resonant = self.day | self.half
        if resonant.any():
            lam, motion, at = self.lam0.copy(), self.n0.copy(), np.zeros_like(t)
            step = np.where(t > 0, STEP, -STEP)
            while (open_ := resonant & (np.abs(t - at) >= STEP)).any():
                speed, slope, bend = self._pull(lam, motion, at)
                lam = np.where(open_, lam + speed * step + slope * STEP * STEP / 2, lam)
                motion = np.where(open_, motion + slope * step + bend * STEP * STEP / 2, motion)
                at = np.where(open_, at + step, at)
            speed, slope, bend = self._pull(lam, motion, at)
            rest = t - at
            n = np.where(resonant, motion + slope * rest + bend * rest * rest / 2, n)
            lam = lam + speed * rest + slope * rest * rest / 2
            theta = np.mod(self.theta0 + t * ROTATION, 2 * np.pi)
            m = np.where(self.half, lam - 2 * node + 2 * theta, np.where(self.day, lam - node - arg + theta, m))
        return e, inc, node, arg, m, n

    def periodic(self, t, e, inc, node, arg, m) -> tuple[np.ndarray, ...]:
        """(e, inclination, node, perigee, anomaly) with the periodic pulls; near the equator the node and perigee by rectangular components."""
        de, di, dm, dg, dh = (a + b for a, b in zip(self.sun.periodic(self.sun_at + SUN["motion"] * t), self.moon.periodic(self.moon_at + MOON["motion"] * t), strict=True))
        inc, e = inc + di, e + de
        si, ci = np.sin(inc), np.cos(inc)
        with np.errstate(all="ignore"):
            steep = inc >= 0.2
            node1, arg1 = node + dh / si, arg + dg - ci * dh / si
            sn, cn = np.sin(node), np.cos(node)
            alpha, beta = si * sn + dh * cn + di * ci * sn, si * cn - dh * sn + di * ci * cn
            lap = np.mod(node, 2 * np.pi)
            sum_ = m + arg + ci * lap + dm + dg - di * lap * si
            node2 = np.arctan2(alpha, beta)
            node2 = np.where(np.abs(lap - node2) > np.pi, np.where(node2 < lap, node2 + 2 * np.pi, node2 - 2 * np.pi), node2)
            arg2 = sum_ - (m + dm) - ci * node2
        return e, inc, np.where(steep, node1, node2), np.where(steep, arg1, arg2), m + dm
