"""Named transformers, joined into plans."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Transformer = Callable[[DataFrame], DataFrame]
_KNOWN: dict[str, Transformer] = {}


def transformer(name: str) -> Callable[[Transformer], Transformer]:
    """Register a function from DataFrame to DataFrame under a name."""

    def keep(f: Transformer) -> Transformer:
        if name in _KNOWN:
            raise ValueError(f"{name} is taken")
        _KNOWN[name] = f
        return f

    return keep


def discover(group: str = "noticeloom.transformers") -> list[str]:
    """Register what installed packages offer; returns all known names."""
    for point in entry_points(group=group):
        _KNOWN.setdefault(point.name, point.load())
    return sorted(_KNOWN)


def named(name: str) -> Transformer:
    try:
        return _KNOWN[name]
    except KeyError:
        raise KeyError(f"no transformer {name}; known: {', '.join(sorted(_KNOWN))}") from None


def chain(*names: str) -> Transformer:
    """One transformer from several, applied from left to right."""

    def run(df: DataFrame) -> DataFrame:
        for name in names:
            df = df.transform(named(name))
        return df

    return run


def fork(left: Transformer, right: Transformer, join: Callable[[DataFrame, DataFrame], DataFrame]) -> Transformer:
    """Two branches of one table, brought together by a function."""
    return lambda df: join(left(df), right(df))


OK, FAILED = "ok", "failed"


def table_function(spark: SparkSession, name: str, work: Callable, returns: str, setup: Callable[[], object] | None = None) -> type:
    """Make a function that gives rows for a row known to SQL: ``SELECT ... FROM t, LATERAL name(t.a, t.b)``.

    work(state, arguments...) yields tuples of the returned columns; state is what setup() gave, once for each
    task. Rows have ``status`` and ``error`` besides: a row that work fails on gives one row without values, with
    the error, and the others of its batch go on. An argument list that gives no rows gives none."""
    width = len(T.StructType.fromDDL(returns).fields)

    class Rows:
        def __init__(self):
            self.state = setup() if setup else None

        def eval(self, *arguments):
            try:
                rows = [tuple(r) for r in work(self.state, *arguments)]
                if any(len(r) != width for r in rows):
                    raise ValueError(f"rows of {width} values are expected")
            except Exception as error:
                yield (*[None] * width, FAILED, f"{type(error).__name__}: {error}"[:2000])
                return
            for r in rows:
                yield (*r, OK, None)

    spark.udtf.register(name, F.udtf(Rows, returnType=f"{returns}, status string, error string"))
    return Rows


def register_functions(spark: SparkSession) -> list[str]:
    """Make column functions of the library known to SQL."""
    from noticeloom.functions.images import exif_orientation
    from noticeloom.operators.boxes import aligned

    for name, f in (("exif_orientation", exif_orientation), ("aligned", aligned)):
        spark.udf.register(name, f)
    return ["exif_orientation", "aligned"]
