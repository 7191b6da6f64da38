"""Stable identities and canonical digests as Catalyst expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def make_id(kind: str, *parts) -> Column:
    """``kind:`` and 128 bits over the JSON array [kind, parts...]; JSON framing keeps part
    boundaries, so no two different lists of parts share an input text."""
    framed = F.to_json(F.array(F.lit(kind), *[_col(p).cast("string") for p in parts]))
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(framed, 256), 1, 32))


def digest(value) -> Column:
    return F.sha2(_col(value), 256)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Key-sorted compact JSON of open documents; null when the text is not JSON."""

    def one(text):
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"),
                              ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return texts.map(one)


def unordered_digest(rows: Column) -> Column:
    """Aggregate: an order-free digest of a multiset of row digests that never gathers them.

    Each row contributes four independent 60-bit words; sums and the count are combined
    map-side, so any number of rows in one group costs one small state.
    """
    text = digest(rows)
    words = [
        F.sum(F.conv(F.substring(text, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
        for i in range(4)
    ]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"),
                              *[w.cast("string") for w in words]), 256)


def policy_canonical(pid, prefix, purpose, forbidden) -> Column:
    """Order-free canonical text of a path policy (arguments already normalized)."""
    paths = F.array_sort(F.array_distinct(_col(forbidden)))
    return F.concat_ws(
        ",", F.to_json(F.array(_col(pid), _col(prefix), _col(purpose))), F.to_json(paths)
    )


def split_qualified(value) -> Column:
    """Parts of a qualified name: dots inside ``<...>`` (and its JSON strings) do not split.

    One pass over the characters with the nesting depth, whatever it is.  Inside brackets a quoted
    string hides brackets and dots; an opening bracket that never closes hides the rest.
    """
    text = _col(value)
    start = F.struct(
        F.array().cast("array<string>").alias("parts"), F.lit("").alias("part"),
        F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))

    def step(s: Column, c: Column) -> Column:
        quote = (c == '"') & ~s["escaped"] & (s["depth"] > 0)
        free = ~s["quoted"]
        depth = (F.when(free & (c == "<"), s["depth"] + 1)
                 .when(free & (c == ">") & (s["depth"] > 0), s["depth"] - 1)
                 .otherwise(s["depth"]))
        cut = (c == ".") & (s["depth"] == 0)
        return F.struct(
            F.when(cut, F.array_append(s["parts"], s["part"])).otherwise(s["parts"]).alias("parts"),
            F.when(cut, F.lit("")).otherwise(F.concat(s["part"], c)).alias("part"),
            depth.alias("depth"),
            F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"))

    return F.aggregate(F.split(text, ""), start, step,
                       lambda s: F.array_append(s["parts"], s["part"]))


def display_name(value, callback: str = "callback", anonymous: str = "anonymous") -> Column:
    """Readable form of a qualified name; callback segments show the call that receives them."""
    value = _col(value)
    pattern = r"^<callback:(\[[\s\S]*\]):(\d+)>$"

    def segment(part: Column) -> Column:
        tokens = F.from_json(F.regexp_extract(part, pattern, 1), "array<array<string>>")
        broken = F.exists(tokens, lambda t: (F.size(t) < 2) | t[1].isNull())
        name = F.array_join(F.transform(tokens, lambda t: t[1]), "")
        short = F.when(F.length(name) > 40, F.concat(F.substring(name, 1, 39), F.lit("…")))
        shown = F.concat(F.coalesce(short, name), F.lit("(…) " + callback))
        usable = part.rlike(pattern) & ~F.coalesce(broken, F.lit(True)) & (name != "")
        return F.when(part == "<anonymous>", anonymous).when(usable, shown).otherwise(part)

    readable = F.array_join(F.transform(split_qualified(value), segment), " › ")
    return F.when(value.contains("<"), readable).otherwise(value)
