"""SGP4 on NumPy arrays, after the published model (Spacetrack Report 3 and its 2006 revision).

One call propagates many element sets at once; nothing loops over objects.  Orbits with periods
of 225 minutes and more take their deep-space terms from :mod:`perigee.functions.deep_space`; these
depend on the date, so without an epoch such rows get the code ``deep_space`` and no state.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np

from perigee.functions.deep_space import DeepSpace

# WGS-72 as the model uses it.
RADIUS_KM, MU, J2, J3, J4 = 6378.135, 398600.8, 0.001082616, -0.00000253881, -0.00000165597
XKE = 60.0 / np.sqrt(RADIUS_KM**3 / MU)
DEEP_SPACE_MINUTES = 225.0

#: Result codes, in the order in which they are tested.
CODES = ("ok", "not_finite", "bad_elements", "deep_space", "mean_eccentricity", "mean_motion", "semilatus", "decayed")


def mean_orbits(inclination_deg, node_deg, eccentricity, perigee_deg, anomaly_deg, motion_rev_day, bstar, epoch_jd=None) -> SimpleNamespace:
    """What element sets say whatever the time: orbits without perturbations, drag's coefficients, secular rates, and codes."""
    inc, node0, e0, arg0, m0, n_day, bstar = (np.asarray(x, np.float64) for x in (inclination_deg, node_deg, eccentricity, perigee_deg, anomaly_deg, motion_rev_day, bstar))
    code = np.zeros(len(inc), np.int64)

    def fail(where: np.ndarray, name: str) -> None:
        code[(code == 0) & where] = CODES.index(name)

    with np.errstate(all="ignore"):
        total = inc + node0 + e0 + arg0 + m0 + n_day + bstar
        fail(~np.isfinite(total), "not_finite")
        fail((n_day <= 0) | (e0 < 0) | (e0 >= 1), "bad_elements")
        inc, node0, arg0, m0 = np.radians(inc), np.radians(node0), np.radians(arg0), np.radians(m0)
        kozai = n_day * 2 * np.pi / 1440.0

        # the mean motion of the unperturbed orbit
        cosi, sini = np.cos(inc), np.sin(inc)
        theta2 = cosi * cosi
        x3thm1, x1mth2, x7thm1 = 3 * theta2 - 1, 1 - theta2, 7 * theta2 - 1
        beta2 = 1 - e0 * e0
        beta = np.sqrt(beta2)
        a1 = (XKE / kozai) ** (2 / 3)
        base = 0.75 * J2 * x3thm1 / (beta * beta2)
        d1 = base / (a1 * a1)
        a0 = a1 * (1 - d1 * d1 - d1 * (1 / 3 + 134 * d1 * d1 / 81))
        n0 = kozai / (1 + base / (a0 * a0))
        a = (XKE / n0) ** (2 / 3)
        deep = 2 * np.pi / n0 >= DEEP_SPACE_MINUTES
        jd = np.full(len(inc), np.nan) if epoch_jd is None else np.asarray(epoch_jd, np.float64)
        fail(deep & ~np.isfinite(jd), "deep_space")

        # atmospheric drag
        rp = a * (1 - e0)
        perigee = (rp - 1) * RADIUS_KM
        fail(rp < 1, "decayed")
        s_km = np.where(perigee < 98, 20.0, np.where(perigee < 156, perigee - 78, 78.0))
        s = s_km / RADIUS_KM + 1
        q4 = ((120 - s_km) / RADIUS_KM) ** 4
        xi = 1 / (a - s)
        eta = a * e0 * xi
        eta2, e_eta = eta * eta, e0 * eta
        psi = np.abs(1 - eta2)
        coef = q4 * xi**4
        coef1 = coef / psi**3.5
        c2 = coef1 * n0 * (a * (1 + 1.5 * eta2 + e_eta * (4 + eta2)) + 0.375 * J2 * xi / psi * x3thm1 * (8 + 3 * eta2 * (8 + eta2)))
        c1 = bstar * c2
        a30 = -J3 / J2
        c3 = np.where(e0 > 1e-4, -2 * coef * xi * (J3 / J2) * n0 * sini / e0, 0.0)
        c4 = 2 * n0 * coef1 * a * beta2 * (
            eta * (2 + 0.5 * eta2) + e0 * (0.5 + 2 * eta2) - J2 * xi / (a * psi) * (-3 * x3thm1 * (1 - 2 * e_eta + eta2 * (1.5 - 0.5 * e_eta)) + 0.75 * x1mth2 * (2 * eta2 - e_eta * (1 + eta2)) * np.cos(2 * arg0))
        )
        c5 = 2 * coef1 * a * beta2 * (1 + 2.75 * (eta2 + e_eta) + e_eta * eta2)
        simple = deep | (rp < 220 / RADIUS_KM + 1)
        d2 = 4 * a * xi * c1 * c1
        d3 = d2 * xi * c1 / 3 * (17 * a + s)
        d4 = 0.5 * d2 * xi * c1 / 3 * a * xi * (221 * a + 31 * s) * c1
        t2c, t3c = 1.5 * c1, d2 + 2 * c1 * c1
        t4c = 0.25 * (3 * d3 + c1 * (12 * d2 + 10 * c1 * c1))
        t5c = 0.2 * (3 * d4 + 12 * c1 * d3 + 6 * d2 * d2 + 15 * c1 * c1 * (2 * d2 + c1 * c1))

        # secular rates by the zonal harmonics
        po2 = (a * beta2) ** 2
        theta4 = theta2 * theta2
        k1 = 1.5 * J2 / po2 * n0
        k2 = 0.5 * k1 * J2 / po2
        k3 = -0.46875 * J4 / (po2 * po2) * n0
        m_dot = n0 + 0.5 * k1 * beta * x3thm1 + 0.0625 * k2 * beta * (13 - 78 * theta2 + 137 * theta4)
        arg_dot = -0.5 * k1 * (1 - 5 * theta2) + 0.0625 * k2 * (7 - 114 * theta2 + 395 * theta4) + k3 * (3 - 36 * theta2 + 49 * theta4)
        h_dot = -k1 * cosi
        node_dot = h_dot + (0.5 * k2 * (4 - 19 * theta2) + 2 * k3 * (3 - 7 * theta2)) * cosi
        node_drag = 3.5 * beta2 * h_dot * c1
    return SimpleNamespace(
        code=code, total=total, inc=inc, node0=node0, e0=e0, arg0=arg0, m0=m0, bstar=bstar, cosi=cosi,
        sini=sini, theta2=theta2, x3thm1=x3thm1, x1mth2=x1mth2, x7thm1=x7thm1, n0=n0, a=a, deep=deep, jd=jd,
        eta=eta, e_eta=e_eta, coef=coef, c1=c1, c3=c3, c4=c4, c5=c5, a30=a30, simple=simple,
        d2=d2, d3=d3, d4=d4, t2c=t2c, t3c=t3c, t4c=t4c, t5c=t5c, m_dot=m_dot, arg_dot=arg_dot,
        node_dot=node_dot, node_drag=node_drag,
    )


def least_radius(o: SimpleNamespace, i: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A radius (km) that orbits ``i`` of :func:`mean_orbits` stay over, without a code, at all minutes from start to end; NaN where none is assured.

    Drag's polynomials are held at their worst between the two times and all angles at their worst
    of a turn, so no state is computed.  Deep-space orbits have none.
    """
    with np.errstate(all="ignore"):
        across = start * end < 0

        def most(c: np.ndarray, k: int) -> np.ndarray:
            top = np.maximum(c * start**k, c * end**k)
            return top if k % 2 else np.where(across, np.maximum(top, 0), top)

        bstar, simple = o.bstar[i], o.simple[i]
        shrink = 1 - most(o.c1[i], 1) - np.where(simple, 0.0, most(o.d2[i], 2) + most(o.d3[i], 3) + most(o.d4[i], 4))
        linear, sway = bstar * o.c4[i], np.where(simple, 0.0, bstar * o.c5[i])
        middle = o.e0[i] + sway * np.sin(o.m0[i])
        low, high = middle - most(linear, 1) - np.abs(sway), np.maximum(middle + most(-linear, 1) + np.abs(sway), 1e-6)
        am = o.a[i] * shrink * shrink
        e = high + np.abs(0.5 * o.a30 * o.sini[i]) / (am * (1 - high * high))
        pl = am * (1 - e * e)
        h1 = 0.5 * J2 / pl
        r = am * (1 - e) * (1 - 1.5 * h1 / pl * np.maximum(o.x3thm1[i], 0)) - 0.5 * h1 * o.x1mth2[i]
        sure = (o.code[i] == 0) & ~o.deep[i] & (shrink > 0) & (low > -0.001 + 1e-9) & (high < 1) & (e < 1) & (r > 1)
        sure &= np.isfinite(o.t5c[i] * np.maximum(np.abs(start), np.abs(end)) ** 5)
        return np.where(sure, r * RADIUS_KM, np.nan)


def propagate(inclination_deg, node_deg, eccentricity, perigee_deg, anomaly_deg, motion_rev_day, bstar, minutes, epoch_jd=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (n, 3) in km and velocities (n, 3) in km/s in the TEME frame, and codes (indices of :data:`CODES`).

    Arguments are arrays of one length; ``minutes`` count from the element set's epoch, which
    ``epoch_jd`` gives as Julian days (NaN where unknown).  Rows with a code have NaN states.
    """
    o, t = mean_orbits(inclination_deg, node_deg, eccentricity, perigee_deg, anomaly_deg, motion_rev_day, bstar, epoch_jd), np.asarray(minutes, np.float64)

    with np.errstate(all="ignore"):
        code = np.where(np.isfinite(o.total + t), o.code, CODES.index("not_finite"))

        def fail(where: np.ndarray, name: str) -> None:
            code[(code == 0) & where] = CODES.index(name)

        cosi, sini, theta2, x3thm1, x1mth2, x7thm1 = o.cosi, o.sini, o.theta2, o.x3thm1, o.x1mth2, o.x7thm1
        # to the time asked for
        m_df, arg_df, node_df = o.m0 + o.m_dot * t, o.arg0 + o.arg_dot * t, o.node0 + o.node_dot * t
        t2 = t * t
        arg, m = arg_df, m_df
        node = node_df + o.node_drag * t2
        shrink, drag_e, drag_l = 1 - o.c1 * t, o.bstar * o.c4 * t, o.t2c * t2
        arg_coef = np.where(o.simple, 0.0, o.bstar * o.c3 * np.cos(o.arg0))
        m_coef = np.where(o.simple | (o.e0 <= 1e-4), 0.0, -2 / 3 * o.coef * o.bstar / o.e_eta)
        turn = arg_coef * t + m_coef * ((1 + o.eta * np.cos(m_df)) ** 3 - (1 + o.eta * np.cos(o.m0)) ** 3)
        m = np.where(o.simple, m, m_df + turn)
        arg = np.where(o.simple, arg, arg_df - turn)
        t3, t4 = t2 * t, t2 * t2
        shrink = np.where(o.simple, shrink, shrink - o.d2 * t2 - o.d3 * t3 - o.d4 * t4)
        drag_e = np.where(o.simple, drag_e, drag_e + o.bstar * o.c5 * (np.sin(m) - np.sin(o.m0)))
        drag_l = np.where(o.simple, drag_l, drag_l + o.t3c * t3 + t4 * (o.t4c + t * o.t5c))
        far = np.flatnonzero(o.deep & (code == 0))
        nm, em, tilt0, terms = o.n0.copy(), o.e0.copy(), o.inc.copy(), None
        if len(far):
            terms = DeepSpace(*(x[far] for x in (o.jd, o.e0, o.arg0, o.inc, o.node0, o.n0, o.m0, o.m_dot, o.arg_dot, o.node_dot)), XKE)
            em[far], tilt0[far], node[far], arg[far], m[far], nm[far] = terms.secular(t[far], node[far], arg[far], m[far])
        fail(~(nm > 0), "mean_motion")
        am = (XKE / nm) ** (2 / 3) * shrink * shrink
        nm = XKE / am**1.5
        em = em - drag_e
        fail((em >= 1) | (em < -0.001), "mean_eccentricity")
        fail(~(am > 0), "mean_motion")
        em = np.maximum(em, 1e-6)
        m = m + o.n0 * drag_l
        lon = np.mod(m + arg + node, 2 * np.pi)
        node, arg = np.mod(node, 2 * np.pi), np.mod(arg, 2 * np.pi)
        m = np.mod(lon - arg - node, 2 * np.pi)
        if terms is not None:
            em[far], tilt0[far], node[far], arg[far], m[far] = terms.periodic(t[far], em[far], tilt0[far], node[far], arg[far], m[far])
            under = tilt0 < 0
            tilt0, node, arg = np.where(under, -tilt0, tilt0), np.where(under, node + np.pi, node), np.where(under, arg - np.pi, arg)
            fail((em < 0) | (em > 1), "mean_eccentricity")
            cosi, sini = np.cos(tilt0), np.sin(tilt0)
            theta2 = cosi * cosi
            x3thm1, x1mth2, x7thm1 = 3 * theta2 - 1, 1 - theta2, 7 * theta2 - 1

        # long-period terms and Kepler's equation
        axn = em * np.cos(arg)
        near = 1 / (am * (1 - em * em))
        ayn = em * np.sin(arg) + near * 0.5 * o.a30 * sini
        over = np.where(np.abs(1 + cosi) > 1.5e-12, 1 + cosi, 1.5e-12)
        u = np.mod(m + arg + near * 0.25 * o.a30 * sini * (3 + 5 * cosi) / over * axn, 2 * np.pi)
        ecc = u.copy()
        for _ in range(10):
            step = (u - ayn * np.cos(ecc) + axn * np.sin(ecc) - ecc) / (1 - np.cos(ecc) * axn - np.sin(ecc) * ayn)
            ecc += np.clip(step, -0.95, 0.95)
            if not (np.abs(step) >= 1e-12).any():
                break
        se, ce = np.sin(ecc), np.cos(ecc)
        e_cos, e_sin = axn * ce + ayn * se, axn * se - ayn * ce
        el2 = axn * axn + ayn * ayn
        pl = am * (1 - el2)
        fail(pl < 0, "semilatus")
        r = am * (1 - e_cos)
        r_dot, rv_dot = np.sqrt(am) * e_sin / r, np.sqrt(pl) / r
        b = np.sqrt(1 - el2)
        f = e_sin / (1 + b)
        su0, cu0 = am / r * (se - ayn - axn * f), am / r * (ce - axn + ayn * f)
        angle = np.arctan2(su0, cu0)
        sin2, cos2 = 2 * cu0 * su0, 1 - 2 * su0 * su0

        # short-period terms
        h1 = 0.5 * J2 / pl
        h2 = h1 / pl
        rr = r * (1 - 1.5 * h2 * b * x3thm1) + 0.5 * h1 * x1mth2 * cos2
        angle = angle - 0.25 * h2 * x7thm1 * sin2
        up = node + 1.5 * h2 * cosi * sin2
        tilt = tilt0 + 1.5 * h2 * cosi * sini * cos2
        r_dot = r_dot - nm * h1 * x1mth2 * sin2 / XKE
        rv_dot = rv_dot + nm * h1 * (x1mth2 * cos2 + 1.5 * x3thm1) / XKE
        fail(rr < 1, "decayed")

        su, cu, sn, cn, st, ct = np.sin(angle), np.cos(angle), np.sin(up), np.cos(up), np.sin(tilt), np.cos(tilt)
        ahead = np.stack([-sn * ct * su + cn * cu, cn * ct * su + sn * cu, st * su], 1)
        across = np.stack([-sn * ct * cu - cn * su, cn * ct * cu - sn * su, st * cu], 1)
        position = rr[:, None] * ahead * RADIUS_KM
        velocity = (r_dot[:, None] * ahead + rv_dot[:, None] * across) * (RADIUS_KM * XKE / 60)
    fail(~np.isfinite(position).all(1) | ~np.isfinite(velocity).all(1), "not_finite")
    position[code != 0] = np.nan
    velocity[code != 0] = np.nan
    return position, velocity, code
