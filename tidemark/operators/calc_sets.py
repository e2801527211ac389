"""Named sets of calculations with parameters: used many times, they become one list without repeats for ``run_calcs``."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import is_number
from tidemark.operators.calc import Calc, in_waves, run_calcs


@dataclass(frozen=True)
class Use:
    """A set under its name; its outputs come as ``<out>_<output>``.  ``args`` gives each of its parameters a column or a number."""

    name: str
    out: str
    args: dict = field(default_factory=dict)


class CalcSets:
    """Sets by name.  Members are calculations and uses of other sets; "$p" in their inputs, options and arguments is the parameter p."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[tuple[str, ...], tuple[Calc | Use, ...]]] = {}

    def add(self, name: str, params: tuple[str, ...], *members: Calc | Use) -> CalcSets:
        if name in self._known:
            raise ValueError(f"set {name} is there already")
        self._known[name] = (params, members)
        return self

    def expand(self, *uses: Use) -> list[Calc]:
        """The calculations of all uses under their full names; a set that uses itself, at any depth, is an error."""
        return [c for use in uses for c in self._expand(use, ())]

    def _members(self, name: str, within: tuple[str, ...]):
        if name in within:
            raise ValueError(f"sets in a circle: {' > '.join((*within, name))}")
        if name not in self._known:
            raise KeyError(f"no set {name}")
        return self._known[name]

    def _outputs(self, name: str, within: tuple[str, ...]) -> list[str]:
        _, members = self._members(name, within)
        return [o for m in members for o in ([f"{m.out}_{x}" for x in self._outputs(m.name, (*within, name))] if isinstance(m, Use) else m.outputs)]

    def _expand(self, use: Use, within: tuple[str, ...]) -> list[Calc]:
        params, members = self._members(use.name, within)
        if set(params) != set(use.args):
            raise ValueError(f"set {use.name} takes {', '.join(params) or 'nothing'}")
        own = {o: f"{use.out}_{o}" for o in self._outputs(use.name, within)}

        def bound(x):
            if isinstance(x, str) and x.startswith("$"):
                if x[1:] not in params:
                    raise ValueError(f"set {use.name} has no parameter {x[1:]}")
                return use.args[x[1:]]
            return own.get(x, x)

        out: list[Calc] = []
        for m in members:
            if isinstance(m, Use):
                out += self._expand(Use(m.name, f"{use.out}_{m.out}", {p: bound(x) for p, x in m.args.items()}), (*within, use.name))
            else:
                out.append(Calc(m.op, tuple(map(bound, m.inputs)), f"{use.out}_{m.out}", {k: bound(v) for k, v in m.options.items()}))
        return out


def without_repeats(calcs: list[Calc]) -> tuple[list[Calc], dict[str, str]]:
    """Each different calculation once, and for every output the column that holds it.

    Two are the same if operation, options and inputs are, where an input that is itself a repeat counts as its first form.
    """
    names = {o for c in calcs for o in c.outputs}
    at: dict[str, str] = {}
    first: dict[tuple, Calc] = {}
    for wave in in_waves(calcs):
        for c in wave:
            if [x for x in c.needs if x in names and x not in at]:
                raise ValueError(f"calculations in a circle: {', '.join(x.out for x in wave)}")
            moved = replace(c, inputs=tuple(at.get(x, x) for x in c.inputs))
            same = (c.op, tuple(float(x) if is_number(x) else x for x in moved.inputs), tuple(sorted(c.options.items())))
            kept = first.setdefault(same, moved)
            at |= dict(zip(c.outputs, kept.outputs))
    return list(first.values()), at


def run_sets(df: DataFrame, sets: CalcSets, *uses: Use, clean_inputs: bool = True) -> DataFrame:
    """``df`` with the outputs of all uses.

    All of them are one run of ``run_calcs``, so a grid of periods takes the shuffle and the sort of one calculation; what
    several uses share is computed once.  An output named as a column of ``df`` is an error.
    """
    calcs, at = without_repeats(sets.expand(*uses))
    clash = sorted(set(at) & set(df.columns))
    if clash:
        raise ValueError(f"columns are there already: {', '.join(clash)}")
    return run_calcs(df, calcs, clean_inputs).select(*df.columns, *[F.col(c).alias(name) for name, c in at.items()])
