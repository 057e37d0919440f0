"""Nautical depth zones and tactical symbol codes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolake.functions.values import color

#: Colour tokens of sea charts, day palette.
CHART_COLORS = {
    "DEPDW": (180, 210, 240),
    "DEPMD": (200, 225, 245),
    "DEPVS": (180, 230, 230),
    "DEPIT": (140, 200, 180),
    "LANDA": (230, 210, 170),
    "LANDG": (180, 210, 160),
    "CHMGD": (200, 50, 150),
    "DNGHL": (255, 0, 0),
    "CHMGF": (180, 100, 200),
    "TRFCD": (200, 50, 200),
    "RESBL": (100, 100, 200),
    "NODTA": (200, 200, 200),
}
#: What the palettes make of the day's channels, as numerator and denominator.
PALETTES = {"day": (1, 1), "dusk": (2, 3), "night": (1, 3)}


def depth_token(depth: Column, shallow: float = 5.0, safety: float = 30.0) -> Column:
    """The colour token of a depth: drying, shallow, medium, deep."""
    return F.when(depth < 0, "DEPIT").when(depth < shallow, "DEPVS").when(depth < safety, "DEPMD").otherwise("DEPDW")


def chart_color(token: Column, palette: str = "day") -> Column:
    times, over = PALETTES[palette]
    out = F.when(F.lit(False), color(0, 0, 0))
    for name, rgb in CHART_COLORS.items():
        out = out.when(token == name, color(*[c * times // over for c in rgb]))
    return out


def sounding_color(depth: Column, safety_depth: float = 30.0) -> Column:
    """Danger red, of the day palette whatever else is used, for soundings above the safety depth; black for others."""
    return F.when(depth < safety_depth, color(*CHART_COLORS["DNGHL"])).otherwise(color(0, 0, 0))


#: The characters of a symbol code by place.
AFFILIATIONS = {"P": "Pending", "0": "Pending", "U": "Unknown", "1": "Unknown", "A": "AssumedFriend", "2": "AssumedFriend", "F": "Friend", "3": "Friend", "N": "Neutral", "4": "Neutral", "S": "Suspect", "5": "Suspect", "H": "Hostile", "6": "Hostile", "J": "Joker", "K": "Faker"}
DIMENSIONS = {"A": "Air", "0": "Air", "G": "Ground", "1": "Ground", "S": "Sea", "2": "Sea", "U": "Subsurface", "3": "Subsurface", "P": "Space", "4": "Space"}
STATUSES = {"P": "Present", "0": "Present", "A": "Planned", "1": "Planned", "C": "FullyCapable", "2": "FullyCapable", "D": "Damaged", "3": "Damaged", "X": "Destroyed", "4": "Destroyed", "F": "FullToCapacity", "5": "FullToCapacity"}
ECHELONS = {"A": "Team", "B": "Squad", "C": "Section", "D": "Platoon", "E": "Company", "F": "Battalion", "G": "Regiment", "H": "Brigade", "I": "Division", "J": "Corps", "K": "Army", "L": "ArmyGroup", "M": "Region", "N": "Command"}
FRAME_COLORS = {"friend": (128, 224, 255), "hostile": (255, 128, 128), "neutral": (170, 255, 170), "unknown": (255, 255, 128)}
_FRIENDS, _FOES = ("Friend", "AssumedFriend"), ("Hostile", "Suspect", "Joker", "Faker")


def _lookup(c: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], F.lit(default))


def parse_sidc(code: Column) -> Column:
    """struct of a symbol code's parts; null for fewer than 15 characters. Unknown characters have defaults."""
    at = lambda i: F.substring(code, i + 1, 1)
    modifier = at(4)
    parts = F.struct(
        _lookup(at(1), AFFILIATIONS, "Unknown").alias("affiliation"),
        _lookup(at(2), DIMENSIONS, "Unknown").alias("dimension"),
        _lookup(at(3), STATUSES, "Present").alias("status"),
        _lookup(at(5), ECHELONS, "None").alias("echelon"),
        modifier.isin("A", "1").alias("headquarters"),
        modifier.isin("B", "2", "D", "4").alias("task_force"),
        modifier.isin("C", "3", "D", "4").alias("feint_dummy"),
        F.substring(code, 7, 9).alias("entity_code"),
    )
    return F.when(F.length(code) >= 15, parts)


def frame_color(sidc: Column) -> Column:
    a = sidc["affiliation"]
    pick = F.when(a.isin(*_FRIENDS), color(*FRAME_COLORS["friend"])).when(a.isin(*_FOES), color(*FRAME_COLORS["hostile"])).when(a == "Neutral", color(*FRAME_COLORS["neutral"]))
    return F.when(a.isNotNull(), pick.otherwise(color(*FRAME_COLORS["unknown"])))


def frame_shape(sidc: Column) -> Column:
    a, d = sidc["affiliation"], sidc["dimension"]
    return F.when(a.isNotNull(), F.when(a.isin(*_FRIENDS), "Rectangle").when(a.isin(*_FOES), "Diamond").when(a == "Neutral", "Square").when(d.isin("Air", "Space"), "Arc").otherwise("Circle"))
