"""Units, costs, weights and labels as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units per mL.
PER_ML = {"drop": 20.0, "oz": 1 / 29.57, "dash": 1.62, "L": 1 / 1000, "cup": 1 / 236.59, "barspoon": 1 / 5, "mL": 1.0, "splash": 1 / 14.79}
# Strength of a kind where none is stated; other kinds have none.
DEFAULT_ABV = {"Bottle": 0.0, "Liquor": 0.40, "AperitifDigestif": 0.30, "Liqueur": 0.20, "Syrup": 0.0, "Bitters": 0.40, "Juice": 0.0}
BOTTLED = ("Bottle", "Liquor", "AperitifDigestif", "Liqueur", "Syrup", "Bitters")
COUNTED = ("Fruit", "Garnish")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def per_ml(unit: Column) -> Column:
    """Units per mL; NaN for an unknown unit, so that it poisons what it enters."""
    table = F.create_map(*[F.lit(v) for pair in PER_ML.items() for v in pair])
    return F.coalesce(F.try_element_at(table, unit), F.lit(float("nan")))


def convert_volume(amount, from_unit, to_unit) -> Column:
    """``amount`` in another unit. A null amount stays null; a unit that is null or unknown gives NaN."""
    return _col(amount) / per_ml(_col(from_unit)) * per_ml(_col(to_unit))


def cost_oz(kind, unit_cost, unit_volume, unit_count, volume_per_count) -> Column:
    """Cost of an ounce of what is bottled, or of juice; null unless all of it is given."""
    cost, count, whole, single = map(_col, (unit_cost, unit_count, unit_volume, volume_per_count))
    ounces = lambda v: convert_volume(v["amount"], v["unit"], F.lit("oz"))
    bottle = F.when(whole.isNotNull(), F.try_divide(cost, ounces(whole)))
    juice = F.when(single.isNotNull(), F.try_divide(F.try_divide(cost, count), ounces(single)))
    return F.when(_col(kind).isin(*BOTTLED), bottle).when(_col(kind) == "Juice", juice)


def cost_count(kind, unit_cost, unit_count) -> Column:
    """Cost of one fruit or garnish."""
    return F.when(_col(kind).isin(*COUNTED), F.try_divide(_col(unit_cost), _col(unit_count)))


def score_to_weight(score, *, p: float = 0.5, h: float = 0.7, k: float = 1.0, r: float = math.log(2) / 0.03) -> Column:
    """Logistic weight of a similarity; ``p`` at ``h``."""
    e = F.exp((_col(score) - h) * r)
    return p * k * e / (k - p + p * e)


def measure_label(amount, unit) -> Column:
    """An amount with its unit as it reads; units that aren't spoken leave the amount and a space."""
    a, u = _col(amount), _col(unit)
    number = F.when(a == F.floor(a), F.floor(a).cast("string")).otherwise(a.cast("string"))
    plural = lambda one, many: F.when(a == 1, one).otherwise(many)
    word = F.when(u == "dash", plural("dash", "dashes")).when(u == "splash", plural("splash", "splashes")).when(u == "drop", plural("drop", "drops")).when(u == "oz", "oz").otherwise("")
    return F.concat(number, F.lit(" "), word)


def percent_label(x, digits: int = 1) -> Column:
    """A share as percent with so many digits, rounded half up once it is scaled; null stays null."""
    by = 10.0**digits
    return F.when(_col(x).isNotNull(), F.concat(F.format_string(f"%.{digits}f", F.round(_col(x) * 100 * by) / by), F.lit("%")))
