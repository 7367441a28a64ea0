"""String expressions: keys, numbers, shortening, sentence templates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"(\d+(?:\.\d+)?%?)"


def numbers(text: Column, most: int = 3) -> Column:
    """The first numbers and percentages of a text."""
    return F.slice(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), 1, most)


def transitions(text: Column, most: int = 3) -> Column:
    """The first "from A to B" and "A -> B" pairs of numbers, as "A>B"."""
    pair = r"(\d+(?:\.\d+)?%?)\s*(?:->|→|to)\s*(\d+(?:\.\d+)?%?)"
    first, last = (F.regexp_extract_all(text, F.lit(pair), F.lit(k)) for k in (1, 2))
    return F.slice(F.zip_with(first, last, lambda a, b: F.concat(a, F.lit(">"), b)), 1, most)


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut at a space where there is one, with an ellipsis."""
    head = F.left(text, F.lit(most - 1))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.regexp_replace(head, r"\s\S*$", "")), F.lit("…")))


def ends_in_consonant(text: Column) -> Column:
    """Whether the last letter is a Hangul syllable with a final consonant."""
    code = F.ascii(F.right(text, F.lit(1)))
    return (code >= 44032) & (code <= 55203) & (F.pmod(code - 44032, F.lit(28)) > 0)


def with_particle(text: Column, after_consonant: str, after_vowel: str) -> Column:
    return F.concat(text, F.when(ends_in_consonant(text), after_consonant).otherwise(after_vowel))


def tidy_units(text: Column) -> Column:
    """No space between a number and its percent sign; one before other units."""
    return F.regexp_replace(F.regexp_replace(text, r"(\d)\s+%", "$1%"), r"(\d)(ms|min|pp|days?)\b", "$1 $2")


def change_sentence(change_type: Column, direction: Column, target: Column) -> Column:
    """A plain sentence of a change's slots."""
    verb = F.when(direction == "increase", "raised").when(direction == "decrease", "lowered").when(change_type == "add", "added").when(change_type == "remove", "removed").when(change_type == "fix", "fixed").otherwise("changed")
    return F.concat_ws(" ", F.coalesce(target, F.lit("unknown")), F.lit("was"), verb)


def input_hash(*columns: Column) -> Column:
    """SHA-256 of the JSON array of the inputs; null is a value."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(c.cast("string"), F.lit("\0")) for c in columns))), 256)


def batches(rows: DataFrame, shard: str, order: str, text: str, most_chars: int = 2500, most_rows: int = 6) -> DataFrame:
    """``batch``: greedy runs of a shard's rows in order, within both limits; one row at least.

    A row's batch depends on all before it, so each shard is read in order; a shard is one
    worker's share and is meant to be small.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "batch int"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        out, batch, chars, n = [], 0, 0, 0
        for size in frame[text].fillna("").str.len():
            if n and (chars + size > most_chars or n >= most_rows):
                batch, chars, n = batch + 1, 0, 0
            chars, n = chars + size, n + 1
            out.append(batch)
        return frame.assign(batch=out)

    return rows.groupBy(shard).applyInPandas(run, schema)
