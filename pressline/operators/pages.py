"""Pages by key instead of offset: the next page starts behind the last row's sort keys,
so that a deep page costs no more than the first."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

API_LIMIT, TOOL_LIMIT = 100, 50  # most rows of a page, by who asks


@dataclass(frozen=True)
class Key:
    """A sort key: a column, its direction and where nulls stand."""

    column: str
    descending: bool = False
    nulls_first: bool = False

    def order(self) -> Column:
        c = F.col(self.column)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def behind(self, value) -> Column:
        """Rows that stand strictly behind the value in this key alone."""
        c = F.col(self.column)
        if value is None:
            return c.isNotNull() if self.nulls_first else F.lit(False)
        after = c < F.lit(value) if self.descending else c > F.lit(value)
        return F.coalesce(after, F.lit(not self.nulls_first))


def bounded(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"a page has 1 to {most} rows")
    return limit


def after_cursor(rows: DataFrame, keys: list[Key], cursor: str | None) -> DataFrame:
    """The rows behind a cursor, by the keys from left to right. The comparison with the
    first key reaches the scan as a filter where its column does."""
    if cursor is None:
        return rows
    values = json.loads(cursor)
    if len(values) != len(keys):
        raise ValueError("the cursor belongs to another order")
    types = {f.name: f.dataType for f in rows.schema.fields}
    values = [None if v is None else F.lit(v).cast(types[k.column]) for k, v in zip(keys, values)]
    test, equal = F.lit(False), F.lit(True)
    for key, value in zip(keys, values):
        test = test | (equal & key.behind(value))
        equal = equal & (F.col(key.column).isNull() if value is None else F.coalesce(F.col(key.column) == value, F.lit(False)))
    return rows.where(test)


def page(rows: DataFrame, keys: list[Key], limit: int, cursor: str | None = None, most: int = API_LIMIT) -> DataFrame:
    """The next ``limit`` rows behind the cursor in the order of the keys, which together
    are unique, with position (from 1), has_more (is there a row behind the page?) and
    cursor (of each row, to go on from). One row more than asked for is looked at."""
    limit = bounded(limit, most)
    found = after_cursor(rows, keys, cursor).orderBy(*(k.order() for k in keys)).limit(limit + 1)
    # at most most + 1 rows from here on, so one task may number them
    listed = found.agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
    numbered = listed.select(F.posexplode(F.slice("rows", 1, limit)).alias("position", "row"), (F.size("rows") > limit).alias("has_more"))
    fields = F.to_json(F.array(*(F.col("row")[k.column].cast("string") for k in keys)))
    return numbered.select((F.col("position") + 1).alias("position"), "row.*", "has_more", fields.alias("cursor"))


def walk(rows: DataFrame, keys: list[Key], limit: int, most: int = TOOL_LIMIT):
    """Page after page to the end, as lists of rows."""
    cursor = None
    while True:
        found = sorted(page(rows, keys, limit, cursor, most).collect(), key=lambda r: r.position)
        if found:
            yield found
        if not found or not found[-1].has_more:
            return
        cursor = found[-1].cursor
