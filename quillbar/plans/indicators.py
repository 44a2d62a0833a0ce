"""One query per indicator, over every series of bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillbar.functions import indicators as ind
from quillbar.plans import Registry
from quillbar.sources.views import bars, with_views

R = Registry()
_BOOL = {"rising", "falling", "fractals", "crossover", "crossunder", "cross", "exrem", "flip"}


def _add(name: str) -> None:
    sql, spec = ind.twin(name)
    plain = name in _BOOL
    outs = ", ".join(c if plain else f"round({c}, {spec.digits}) as {c}" for c in spec.outputs)
    key = [*ind.KEYS, ind.ORDER]

    def run(s, d):
        o = ind.apply(bars(s, d), name)
        return o.select(*key, *[F.col(c) if plain else F.round(c, spec.digits).alias(c) for c in spec.outputs])

    R.add(f"t_{name}", with_views("bars", sql.format(outs)))(run)


for _n in ind.REGISTRY:
    _add(_n)
