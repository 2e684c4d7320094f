"""SQL text for work on arrays that stays near linear, however long the array.

Text rather than columns: nested lambdas that are built column by column take seconds of a driver's time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def let(name: str, value: str, body: str) -> str:
    """body, in which `name` stands for value, computed once however often body names it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(values: str, combine: str, start: str) -> str:
    """At each place, all values up to it put together by `combine`, an associative operation on x and y that has `start` as its neutral value.

    Rounds double the reach, so n values take n log n steps; an array that grows by one value at a time takes n squared."""
    reach = "CAST(pow(2, run_k) AS INT)"
    moved = f"concat(array_repeat({start}, {reach}), slice(run_acc, 1, size(run_v) - {reach}))"
    rounds = "sequence(0, CAST(ceil(log2(size(run_v))) AS INT) - 1)"
    scan = f"aggregate({rounds}, run_v, (run_acc, run_k) -> zip_with({moved}, run_acc, (x, y) -> {combine}))"
    return let("run_v", values, f"CASE WHEN size(run_v) > 1 THEN {scan} ELSE run_v END")


def running_sum(values: str) -> str:
    """Sums of an array of bigint up to and with each place."""
    return running(values, "x + y", "0L")


def running_total(values: Column) -> Column:
    """`running_sum` of a column."""

    def scanned(v: Column) -> Column:
        def round_of(acc: Column, k: Column) -> Column:
            reach = F.pow(F.lit(2), k).cast("int")
            return F.zip_with(F.concat(F.array_repeat(F.lit(0).cast("bigint"), reach), F.slice(acc, F.lit(1), F.size(v) - reach)), acc, lambda x, y: x + y)

        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1)
        return F.when(F.size(v) > 1, F.aggregate(rounds, v, round_of)).otherwise(v)

    return F.element_at(F.transform(F.array(values), scanned), 1)
