"""What an input and a forecast must be, as columns: null where a row is right, else the rule it breaks.

The same columns guard a batch, a stream before its state, and the driver's own stepping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SCENARIO_TABLE
from ..errors import InputValidationError
from ..functions.physics import finite

#: The values of a step; all must be finite, and all but the outdoor temperature nonnegative.
VALUES = ("load", "price", "ci", "outdoor", "renewable")
SIGNED = frozenset(["outdoor"])
#: How many steps, this one included, a controller may see.
REACH = {name: steps for name, _, steps in SCENARIO_TABLE} | {"external": 1}


def _first(*rules: tuple[Column, str | Column]) -> Column:
    out = F.lit(None).cast("string")
    for broken, text in reversed(rules):
        out = F.when(broken, text if isinstance(text, Column) else F.lit(text)).otherwise(out)
    return out


def input_error(names: dict[str, str] | None = None, time: str = "at") -> Column:
    """The broken rule of a step's own values; ``names``: their columns."""
    c = {k: F.col((names or {}).get(k, k)) for k in VALUES}
    rules = [(F.col(time).isNull(), "no time")] + [(~finite(x), f"{k} is not finite") for k, x in c.items()] + [(x < 0, f"{k} is negative") for k, x in c.items() if k not in SIGNED]
    return _first(*rules)


def forecast_error(forecast: str = "forecast", time: str = "at", controller: str = "controller", reach: dict[str, int] | None = None) -> Column:
    """The broken rule of a window (array of structs with ``at``): it begins at the current
    step, its times increase, and it is no longer than the controller may see. A null
    window stands for the current step alone."""
    w = F.col(forecast)
    most = F.element_at(F.create_map(*[F.lit(x) for pair in (REACH | (reach or {})).items() for x in pair]), F.col(controller))
    times = F.transform(w, lambda s: s["at"])
    n = F.size(w)
    ordered = F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (n < 2) | (F.get(times, i) > F.get(times, i - 1)))
    return _first(
        (w.isNull(), F.lit(None).cast("string")), (most.isNull(), "unknown controller"), (n == 0, "the forecast is empty"), (~F.get(times, F.lit(0)).eqNullSafe(F.col(time)), "the forecast does not begin at the current step"),
        (~F.coalesce(ordered, F.lit(False)), "the forecast's times do not increase"), (n > most, F.format_string("the controller may see %d steps at most", most)),
    )


def window_row(forecast: str, offset: int | Column) -> Column:
    """A step of a window; an error outside of it, so nothing past the horizon is ever read."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    return F.when((at < 0) | (at >= F.size(forecast)), F.raise_error(F.lit("outside of the forecast window"))).otherwise(F.get(F.col(forecast), at))


def window_values(df: DataFrame, forecast: str, name: str) -> Column:
    """One signal of a window, as an array; an error if the window has none of that name."""
    names = df.schema[forecast].dataType.elementType.names
    if name not in names:
        raise InputValidationError(f"no signal {name} in the window; it has {', '.join(names)}")
    return F.transform(forecast, lambda s: s[name])
