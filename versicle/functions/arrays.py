"""Array and number helpers that stay inside one row."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(sizes: Column) -> Column:
    """Sum of all earlier elements for each element of an int array, by blocks of about its square root: k ** 1.5 steps."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda t, x: t + x)

    def of(s: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(s))).cast("int"))
        starts = F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)))

        def by_block(w: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / w).cast("int")), lambda b: total(F.slice(s, b * w + 1, w)))
            heads = let(blocks, lambda t: F.transform(t, lambda _, b: total(F.slice(t, F.lit(1), b))))
            return let(heads, lambda h: F.transform(starts, lambda i: F.get(h, F.floor(i / w).cast("int")) + total(F.slice(s, F.floor(i / w).cast("int") * w + 1, i % w))))

        return F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(let(width, by_block))

    return let(sizes, of)


def half_even(value: Column, places: int) -> Column:
    """value rounded to decimal places, to the even one at a tie. What decides is the exact binary value, not the shortest
    decimal that stands for it: value is split in two so that its product with 2 * 10^places has no rounding error."""
    twice = 2.0 * 10**places
    near = F.rint(value * twice)
    wide = value * 134217729.0
    high = wide - (wide - value)
    over = (high * twice - near) + (value - high) * twice
    below, above = (near - 1) / 2, (near + 1) / 2
    even = F.when(below % 2 == 0, below).otherwise(above)
    between = F.when(over > 0, above).when(over < 0, below).otherwise(even)
    return F.when(near % 2 == 0, near / 2).otherwise(between) / 10.0**places
