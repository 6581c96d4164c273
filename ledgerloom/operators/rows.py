"""CSV records that fail to parse: valid rows loaded, the others set apart with the reason.

One anchored pattern per schema accepts a whole valid row, so a valid row costs
one match. Only rows that fail it meet the further patterns: the row as any
number of well-formed fields (quoting), with the header's number of fields
(column count), and prefixes of one field more each, of which the first that
fails names the broken field. All quantifiers around fields are possessive:
they neither backtrack nor recurse, so very long fields are safe.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTING, COLUMN_COUNT, VALUE = "quoting", "column_count", "value"

_QUOTED = r'(?:"[^"]*+")++'
_FIELD = rf'(?:{_QUOTED}|[^",]*+)'
_END = r"(?![\s\S])"
_NUMBER = r"(?:[0-9]{1,3}(?:,[0-9]{3})++|[0-9]++)(?:\.[0-9]{1,2})?"
_PLAIN_NUMBER = r"[0-9]++(?:\.[0-9]{1,2})?"


def _amount(number: str) -> str:
    return rf"\s*+(?:[+-]?\$?{number}|\(\$?{number}\))\s*+"


@dataclass(frozen=True)
class Feed:
    """A feed's name, its header, and which of its columns hold amounts."""

    name: str
    header: tuple[str, ...]
    amounts: tuple[str, ...] = field(default=())

    def _piece(self, column: str) -> str:
        if column not in self.amounts:
            return _FIELD
        return rf'(?:"{_amount(_NUMBER)}"|{_amount(_PLAIN_NUMBER)})(?=,|{_END})'

    def whole_row(self) -> str:
        return "^" + ",".join(self._piece(c) for c in self.header) + _END

    def counted(self) -> str:
        return "^" + ",".join([_FIELD] * len(self.header)) + _END

    def prefix(self, upto: int) -> str:
        return "^" + ",".join(self._piece(c) for c in self.header[: upto + 1]) + rf"(?=,|{_END})"


WELL_QUOTED = rf"^{_FIELD}(?:,{_FIELD})*+{_END}"


def _by_feed(feed: Column, feeds: list[Feed], make) -> Column:
    out = F.lit(None)
    for f in reversed(feeds):
        out = F.when(feed == f.name, make(f)).otherwise(out)
    return out


def classify(df: DataFrame, text: str, feed: str, feeds: list[Feed], reason: str = "reason", broken: str = "broken_field") -> DataFrame:
    """Add ``reason`` (null: valid) and the name of the first broken field.

    A row that the pattern of whole rows doesn't match is tried field by field:
    the first prefix of well-quoted fields that doesn't fit ends at a missing
    field (the row ends before it) or at broken quoting; if all fit, the row has
    surplus fields or a wrong value.
    The reason is the first that applies of ``quoting`` (a double quote other
    than around a whole field or doubled inside one), ``column_count`` and
    ``value``. A null text is ``column_count`` with no broken field, an empty
    text is one empty field. The broken field of a wrong count is the first
    surplus (``+``) or missing column. Rows of a feed that ``feeds`` doesn't
    have get reason ``feed``. Columns already named like the new ones are replaced.
    """
    t, f = F.col(text), F.col(feed)

    def why(x: Feed) -> Column:
        out = F.when(t.rlike(x.counted()), VALUE).when(t.rlike(WELL_QUOTED), COLUMN_COUNT).otherwise(QUOTING)
        for k in reversed(range(1, len(x.header) + 1)):
            fields = "^" + ",".join([_FIELD] * k)
            ended = t.rlike("^" + ",".join([_FIELD] * (k - 1)) + _END) if k > 1 else F.lit(False)
            out = F.when(t.rlike(fields + rf"(?=,|{_END})"), out).otherwise(F.when(ended, COLUMN_COUNT).otherwise(QUOTING))
        return F.when(t.isNull(), COLUMN_COUNT).when(t.rlike(x.whole_row()), None).otherwise(out)

    def first_broken(x: Feed) -> Column:
        out = F.lit("+")
        for i in reversed(range(len(x.header))):
            out = F.when(~t.rlike(x.prefix(i)), x.header[i]).otherwise(out)
        return out

    df = df.withColumn(reason, F.when(f.isin([x.name for x in feeds]), _by_feed(f, feeds, why)).otherwise("feed"))
    bad = F.col(reason).isin(QUOTING, COLUMN_COUNT, VALUE) & t.isNotNull()
    return df.withColumn(broken, F.when(bad, _by_feed(f, feeds, first_broken)))


def fields_of(text: Column) -> Column:
    """The fields of a well-quoted record as an array, quotes around them taken off."""
    pieces = F.regexp_extract_all(F.concat(text, F.lit(",")), F.lit(rf"({_FIELD}),"), F.lit(1))
    bare = lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(pieces, bare)


def amount_of(text: Column) -> Column:
    """Decimal value of a valid amount: minus or parentheses make it negative."""
    bare = F.btrim(text, F.lit(" \t\r\n"))
    number = F.regexp_replace(bare, r"[^0-9.]", "").try_cast("decimal(18,2)")
    return F.when(bare.rlike(r"^[-(]"), -number).otherwise(number)


def load(df: DataFrame, text: str, feed: str, schema: Feed, keep: tuple[str, ...] = ()) -> DataFrame:
    """Valid rows of one feed: the columns ``keep``, then the header's, amounts as decimals.

    A kept column named like one of the header's is renamed with a leading ``_``.
    """
    good = classify(df.where(F.col(feed) == schema.name), text, feed, [schema], "_loom_reason", "_loom_broken").where("_loom_reason is null")
    names = {h.lower() for h in schema.header}
    good = good.select(*[F.col(k).alias(f"_{k}" if k.lower() in names else k) for k in keep], fields_of(F.col(text)).alias("_loom_fields"))
    value = lambda i, h: amount_of(F.get("_loom_fields", F.lit(i))) if h in schema.amounts else F.get("_loom_fields", F.lit(i))
    return good.select(*[c for c in good.columns if c != "_loom_fields"], *[value(i, h).alias(h) for i, h in enumerate(schema.header)])


def rejected(df: DataFrame, text: str, feed: str, feeds: list[Feed]) -> DataFrame:
    """The rows that fail, with reason and broken field."""
    return classify(df, text, feed, feeds).where("reason is not null")
