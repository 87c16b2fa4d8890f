"""Lookups and threshold ladders: message classes, vessel categories, severities."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from wakeline import schema as S


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)
    return found if default is None else F.coalesce(found, default)


def basic_class(msg_type: Column) -> Column:
    return lookup(msg_type, S.BASIC_CLASSES, F.lit("Other"))


def task_class(msg_type: Column) -> Column:
    return lookup(msg_type, S.TASK_CLASSES, F.lit("other"))


def node_type(msg_class: Column) -> Column:
    return lookup(msg_class, S.NODE_TYPES, F.lit("other"))


def vessel_category(code: Column) -> Column:
    out = F
    for name, spans in S.VESSEL_CATEGORIES:
        hit = F.lit(False)
        for lo, hi in spans:
            hit = hit | code.between(lo, hi)
        out = out.when(hit, name)
    return out.otherwise("other")


def vessel_length(to_bow: Column, to_stern: Column) -> Column:
    return F.coalesce(to_bow, F.lit(0)) + F.coalesce(to_stern, F.lit(0))


vessel_width = vessel_length


def behaviour(mean_speed: Column) -> Column:
    return (
        F.when(mean_speed.isNull(), "unknown")
        .when(mean_speed < 0.5, "anchored")
        .when(mean_speed < 3, "maneuvering")
        .when(mean_speed < 15, "transit")
        .otherwise("high_speed")
    )


def cpa_warning(cpa_m: Column, tcpa_s: Column, cpa_limit: float = 500.0,
                tcpa_limit: float = 600.0) -> Column:
    inside = (cpa_m <= cpa_limit) & (tcpa_s <= tcpa_limit)
    return (
        F.when(~(tcpa_s > 0), "none")
        .when(inside & (cpa_m <= cpa_limit * 0.5), "critical")
        .when(inside & (cpa_m <= cpa_limit * 0.75), "high")
        .when(inside, "medium")
        .when((cpa_m <= cpa_limit * 1.5) & (tcpa_s <= tcpa_limit * 1.5), "low")
        .otherwise("none")
    )


def collision_risk(cpa_m: Column, tcpa_s: Column) -> Column:
    """1.0 / 0.75 / 0.5 / 0.25 / 0.0 by closest approach and time to it."""
    out = F
    for risk, cpa, tcpa in ((1.0, 250, 300), (0.75, 500, 600), (0.5, 1000, 1200), (0.25, 2000, 1800)):
        out = out.when((cpa_m < cpa) & (tcpa_s < tcpa) & (tcpa_s > 0), risk)
    return out.otherwise(0.0)


def ops_severity(cpa_m: Column, tcpa_s: Column, threat: Column) -> Column:
    close = lambda cpa: (threat != "collision") | (cpa_m < cpa)
    return (
        F.when(close(100) & (tcpa_s < 120), "critical")
        .when(close(300) & (tcpa_s < 300), "high")
        .when(close(500) & (tcpa_s < 600), "medium")
        .otherwise("low")
    )


def alert_tier(cpa_m: Column, tcpa_s: Column) -> Column:
    """Documented three-step coding of collision alerts."""
    return (
        F.when((cpa_m < 500) & (tcpa_s < 600), "high")
        .when((cpa_m < 2000) & (tcpa_s < 1800), "medium")
        .otherwise("low")
    )


def encounter_risk(kind: Column, bearing_1_to_2: Column) -> Column:
    crossing = kind.isin("crossing_starboard", "crossing_port")
    beam = bearing_1_to_2.between(60, 120) | bearing_1_to_2.between(240, 300)
    return (
        F.when(kind == "head_on", "high")
        .when(crossing & beam, "high")
        .when(crossing, "medium")
        .when(kind.isin("overtaking_given", "overtaking_taken"), "medium")
        .when(kind.isin("parallel_same", "parallel_opposite"), "low")
        .otherwise("none")
    )


def clip01(x: Column, scale: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x / scale, F.lit(0.0)), F.lit(1.0)))
