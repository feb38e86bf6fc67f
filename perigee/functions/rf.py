"""Column functions of the link budget, in decibels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from perigee.functions import constants as K


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _positive(x: Column | float) -> Column:
    """The value, or null where it isn't a positive number: results that need it are null too."""
    return F.when((_c(x) > 0) & ~F.isnan(_c(x)), _c(x))


def watts_to_dbw(w: Column | float) -> Column:
    return 10 * F.log10(_positive(w))


def dbw_to_watts(x: Column | float) -> Column:
    return F.pow(F.lit(10.0), _c(x) / 10)


def dbw_to_dbm(x: Column | float) -> Column:
    return _c(x) + 30


def dbm_to_dbw(x: Column | float) -> Column:
    return _c(x) - 30


def fspl_db(range_km: Column | float, ghz: Column | float) -> Column:
    return 92.45 + 20 * F.log10(_positive(range_km)) + 20 * F.log10(_positive(ghz))


def eirp_dbw(tx_dbw: Column | float, gain: Column | float, feeder: Column | float = 0, backoff: Column | float = 0) -> Column:
    return _c(tx_dbw) + gain - feeder - backoff


def received_dbw(eirp: Column, gain: Column | float, path: Column, more: Column | float = 0) -> Column:
    return eirp + gain - path - more


def noise_dbw(bandwidth_hz: Column | float, temperature_k: Column | float = 290) -> Column:
    return watts_to_dbw(K.BOLTZMANN_W_PER_HZ_K * _positive(temperature_k) * _positive(bandwidth_hz))


def g_over_t(gain: Column | float, temperature_k: Column | float) -> Column:
    return _c(gain) - 10 * F.log10(_positive(temperature_k))


def c_over_n0(received: Column, gt: Column, more: Column | float = 0) -> Column:
    return received + gt - more + 228.6


def eb_over_n0(cn0: Column, bit_rate: Column | float) -> Column:
    return cn0 - 10 * F.log10(_positive(bit_rate))


def delay_ms(range_km: Column | float) -> Column:
    return _positive(range_km) * 1000 / K.SPEED_OF_LIGHT_MPS * 1000


def doppler_hz(radial_mps: Column, carrier_hz: Column | float) -> Column:
    return -(radial_mps / K.SPEED_OF_LIGHT_MPS) * _positive(carrier_hz)


def dish_gain_dbi(diameter_m: Column | float, hz: Column | float, efficiency: float = 0.6) -> Column:
    return 10 * F.log10(efficiency * F.pow(math.pi * _positive(diameter_m) * _positive(hz) / K.SPEED_OF_LIGHT_MPS, 2))


def dish_beamwidth_deg(diameter_m: Column | float, hz: Column | float) -> Column:
    return 70 * (K.SPEED_OF_LIGHT_MPS / _positive(hz)) / _positive(diameter_m)


def scan_loss_db(angle_deg: Column) -> Column:
    c = F.cos(F.radians(F.abs(angle_deg)))
    return F.when(c <= 0, F.lit(math.inf)).otherwise(-10 * F.log10(c))


def link_budget(
    range_km: Column,
    ghz: Column | float,
    bandwidth_hz: Column | float,
    tx_dbw: Column | float,
    tx_gain: Column | float,
    rx_gain: Column | float,
    temperature_k: Column | float = 290,
    feeder: Column | float = 0,
    backoff: Column | float = 0,
    more: Column | float = 0,
    required_snr: Column | float = 10,
    required_margin: Column | float = 3,
) -> dict[str, Column]:
    path, eirp = fspl_db(range_km, ghz), eirp_dbw(tx_dbw, tx_gain, feeder, backoff)
    received, noise = received_dbw(eirp, rx_gain, path, more), noise_dbw(bandwidth_hz, temperature_k)
    need = _c(required_snr) + required_margin
    margin = received - noise - need
    need_eirp = need + noise + path + more - rx_gain
    need_tx = need_eirp - tx_gain + feeder + backoff
    return {
        "path_loss_db": path,
        "eirp_dbw": eirp,
        "received_dbw": received,
        "noise_dbw": noise,
        "snr_db": received - noise,
        "margin_db": margin,
        "required_eirp_dbw": need_eirp,
        "required_tx_dbw": need_tx,
        "required_tx_w": dbw_to_watts(need_tx),
        "status": F.when(margin >= 0, "pass").otherwise("fail"),
    }


def margin_bucket(margin: Column, visible: Column) -> Column:
    finite = margin.isNotNull() & ~F.isnan(margin) & (F.abs(margin) != math.inf)
    return F.when(~visible | ~finite, "blocked").when(margin < 0, "negative").when(margin < 3, "thin").when(margin < 10, "good").otherwise("ample")
