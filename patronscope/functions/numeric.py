"""SQL text for rounding, exact sums, banding and literals.

Larger expressions are written as SQL text: Spark parses a text once, while a Python column costs a
round trip to the JVM per operation, which for wide expressions takes longer than small queries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def half_even(value: str, digits: int) -> str:
    """Round a double so that a scaled half goes to the even neighbour."""
    return f"rint(({value}) * 1e{digits}D) / 1e{digits}D"


def exact_total(amount: str) -> str:
    """Sum of cent amounts held as doubles, free of the order the rows arrive in."""
    return f"cast(sum(cast({amount} as decimal(18, 2))) as double)"


def double(value: float) -> str:
    """A double literal with all its digits."""
    return f"{float(value)!r}D"


def quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def quoted_array(texts: Sequence[str]) -> str:
    return f"array({', '.join(quoted(t) for t in texts)})"


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def present(df: DataFrame, name: str) -> str:
    """True for values that are neither null nor NaN."""
    known = f"{name} is not null"
    return f"{known} and not isnan({name})" if is_floating(df, name) else known


def positive(df: DataFrame, name: str) -> str:
    """True for values above zero; NaN, which Spark orders above every number, is not."""
    above = f"{name} > 0"
    return f"{above} and not isnan({name})" if is_floating(df, name) else above


def band(value: str, edges: Sequence[float], labels: Sequence[str]) -> str:
    """Label of the left-open, right-closed band; null at or below the first edge."""
    cases = [
        f"when {value} > {double(edge)} then {quoted(label)}"
        for edge, label in reversed(list(zip(edges, labels)))
    ]
    return f"case {' '.join(cases)} end"
