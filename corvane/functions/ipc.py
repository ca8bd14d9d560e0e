"""Classification codes put together again from a text column that extraction has torn apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The printed forms of classification codes.
SUBCLASS = r"^:?([A-H]\d{2}[A-Z])\z"
GROUP = r"^(\d{1,4}/\d{2,6})\z"
COMPACT = r"^:?([A-H]\d{2}[A-Z])(\d{1,4}/\d{2,6})\z"
#: Fixed width: subclass, four digits of group, six of subgroup.
LONG = r"^:?([A-H]\d{2}[A-Z])(\d{4})(\d{6})\z"
#: How any of these begins; the fold passes over other tokens.
CODELIKE = r"^(:?[A-H]\d{2}[A-Z]|\d{1,4}/)"
INLINE = r"([A-H]\d{2}[A-Z])(?U:\s)+(\d{1,4}/\d{2,6})"
PUBLISHED = r"^[A-Z]\d{2}[A-Z]?\d+/\d+"


def _long_code(token: Column) -> Column:
    group = F.regexp_replace(F.regexp_extract(token, LONG, 2), "^0+(?=.)", "")
    sub = F.regexp_replace(F.regexp_extract(token, LONG, 3), "0+$", "")
    # rpad alone would cut longer subgroups.
    return F.concat(F.regexp_extract(token, LONG, 1), F.lit(" "), group, F.lit("/"), F.when(F.length(sub) >= 2, sub).otherwise(F.rpad(sub, 2, "0")))


def ipc_codes(text: Column) -> Column:
    """The distinct codes of a text in the order in which they end.

    A fold over its tokens keeps the subclass that waits for its group. A whole
    code or another subclass lets a waiting one out alone; a group that nothing
    waits for is passed over. Codes written on one line come after, where the
    fold has not met them.
    """
    nothing = F.lit(None).cast("string")
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f,]+", -1), lambda t: t.rlike(CODELIKE))
    start = F.struct(nothing.alias("open"), F.array().cast("array<string>").alias("out"))
    let_out = lambda a: F.when(a["open"].isNull(), a["out"]).otherwise(F.array_append(a["out"], a["open"]))

    def step(a: Column, t: Column) -> Column:
        whole = F.when(t.rlike(LONG), _long_code(t)).when(t.rlike(COMPACT), F.regexp_replace(t, COMPACT, "$1 $2"))
        return (
            F.when(whole.isNotNull(), F.struct(nothing.alias("open"), F.array_append(let_out(a), whole).alias("out")))
            .when(t.rlike(SUBCLASS), F.struct(F.regexp_extract(t, SUBCLASS, 1).alias("open"), let_out(a).alias("out")))
            .when(t.rlike(GROUP) & a["open"].isNotNull(), F.struct(nothing.alias("open"), F.array_append(a["out"], F.concat_ws(" ", a["open"], t)).alias("out")))
            .otherwise(a)
        )

    walked = F.aggregate(parts, start, step, let_out)
    inline = F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(INLINE), F.lit(1)).alias("s"), F.regexp_extract_all(text, F.lit(INLINE), F.lit(2)).alias("g")), lambda x: F.concat_ws(" ", x["s"], x["g"])
    )
    return F.array_distinct(F.concat(walked, F.coalesce(inline, F.array().cast("array<string>"))))


def only_codes(line: Column) -> Column:
    """Whether a line holds nothing but classification tokens."""
    s = F.regexp_replace(F.trim(F.regexp_replace(line, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")), ",+$", "")
    return s.rlike(SUBCLASS) | s.rlike(GROUP) | s.rlike(r"^([A-H]\d{2}[A-Z](?U:\s)+\d{1,4}/\d{2,6},?(?U:\s)*)+\z")
