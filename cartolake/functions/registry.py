"""Named functions for expressions: builders of columns, used as ["fn", name, ...]."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolake.functions.expressions import Function, unify
from cartolake.functions.values import ARRAY, BOOLEAN, NULL, NUMBER, STRING, Value



def _null() -> Value:
    return Value(NULL, F.lit(None).cast("string"))


def _typed(kinds: list[str], out: str, build: Callable[..., Column]) -> Function:
    """Null unless there are as many arguments as kinds, each of its kind."""

    def call(args: list[Value]) -> Value:
        if [a.kind for a in args] != kinds:
            return _null()
        return Value(out, build(*[a.column for a in args]))

    return call


def _logarithm(build: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(build(x))


def _len(args: list[Value]) -> Value:
    if len(args) != 1 or args[0].kind not in (STRING, ARRAY):
        return _null()
    size = F.octet_length(args[0].column) if args[0].kind == STRING else F.size(args[0].column)
    return Value(NUMBER, size.cast("double"))


def _if_null(args: list[Value]) -> Value:
    if len(args) != 2:
        return _null()
    kind, columns = unify(args)
    return Value(kind, F.coalesce(*columns))


class FunctionRegistry(dict[str, Function]):
    """Functions by name. A name that is registered again is replaced; calling an unknown one gives Null."""

    def register(self, name: str, function: Function) -> None:
        self[name] = function

    def call(self, name: str, args: list[Value]) -> Value:
        return self[name](args) if name in self else _null()

    @classmethod
    def with_builtins(cls) -> FunctionRegistry:
        number = NUMBER
        return cls(
            {
                "clamp": _typed([number] * 3, number, lambda v, lo, hi: F.least(F.greatest(v, lo), hi)),
                "lerp": _typed([number] * 3, number, lambda a, b, t: a + (b - a) * t),
                "pow": _typed([number] * 2, number, F.pow),
                "sqrt": _typed([number], number, F.sqrt),
                "log": _typed([number], number, _logarithm(F.ln)),
                "log10": _typed([number], number, _logarithm(F.log10)),
                "len": _len,
                "contains": _typed([STRING] * 2, BOOLEAN, F.contains),
                "if_null": _if_null,
            }
        )
