"""Records that differ only in form, collapsed by dictionary-encoded tuples."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"
MAX_DICTIONARY = 200_000
_BLANK = re.compile(r"[^\S\n]+")
_HIDDEN = regex.compile(r"[\p{Cf}\p{Cc}--[\s\x1c-\x1f\x85]]", regex.V1)
_HIDDEN_ASCII = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]")
# a run of signs separates words, but for a single mark between two digits
_SIGNS = regex.compile(r"(?<!\p{Nd})[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+(?!\p{Nd})|[^\p{L}\p{M}\p{N}]{2,}")
_SIGNS_ASCII = re.compile(r"(?<![0-9])[^a-z0-9]+|[^a-z0-9]+(?![0-9])|[^a-z0-9]{2,}")
_SPACES = re.compile(r" +")
_FIELD_CUT = re.compile(r"\s*[;|]\s*|\s*\n\s*")
_FIELD = re.compile(r"[^\W\d_](?:[^\W\d_]|[ /]){0,40}?\s*(?::|\s=|\s[–—-])\s*\S")


def _visible(text: str) -> str:
    """In lower case, without invisible characters, every white space but a line end as a plain space."""
    t = text.lower()
    return _BLANK.sub(" ", _HIDDEN_ASCII.sub("", t) if t.isascii() else _HIDDEN.sub("", t))


def _words(visible: str) -> str:
    t = _BLANK.sub(" ", visible.replace("\n", " "))
    t = _SIGNS_ASCII.sub(" ", t) if t.isascii() else _SIGNS.sub(" ", t)
    return _SPACES.sub(" ", t).strip()


def canonical(text: str) -> str:
    """Words and numbers of a text in lower case, one space between them.

    Invisible characters vanish, white space and signs separate words, and a
    single mark between two digits stays part of the number.
    """
    return _words(_visible(text))


def forms(text: str, free_order: bool) -> list[str]:
    """The canonical fields of a text that consists of two or more ``Key: value`` fields, which line ends, ``;`` and ``|``
    separate (``=`` and a spaced dash count as the colon); else its canonical form alone."""
    t = _visible(text)
    if free_order:
        parts = [p for p in (x.strip() for x in _FIELD_CUT.split(t)) if p]
        if len(parts) > 1 and all(map(_FIELD.match, parts)):
            return [_words(p) for p in parts]
    return [_words(t)]


def _codes(text: str, free_order: bool) -> tuple[int, ...]:
    """Sorted integer identifiers of the canonical fields, two 64-bit halves each.

    An identifier is the 128-bit hash of the field, so that all tasks give a
    field the same one and no dictionary has to be joined.
    """
    ids = sorted(xxhash.xxh3_128_intdigest(f.encode("utf-8", "surrogatepass")) for f in forms(text, free_order))
    return tuple(h - (1 << 63) for i in ids for h in (i >> 64, i & (1 << 64) - 1))


def collapse(df: DataFrame, key: str, columns: list[str], free_order: list[str] = (), salts: int = 16) -> DataFrame:
    """(first_key, copy_key, n_copies): every record with the smallest key among its copies.

    Every task keeps a dictionary of the values it has met: each distinct value
    is canonicalised once, split into fields where it consists of ``Key: value``
    fields (columns in ``free_order``), and its fields get integer identifiers.
    A record becomes the tuple of its columns' sorted identifiers, and only
    those compact tuples are shuffled and grouped; no text is, and no value,
    however frequent, brings its rows together in one task.

    Null equals only null; the empty string is a value; repeated keys count as
    rows of their own.  Groups of any size are counted by partial aggregation,
    and the way back from a group to its rows is salted.
    """
    names = [f"_c{i}" for i in range(len(columns))]
    src = df.select(F.col(key).alias("_key"), *[F.col(c).cast("string").alias(n) for c, n in zip(columns, names)])
    free = [c in free_order for c in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, str], tuple[int, ...]] = {}
        for b in batches:
            values = [b[n].to_numpy(object) for n in names]
            out = []
            for row in zip(*values):
                code: list[int] = []
                for i, v in enumerate(row):
                    if v is None:
                        code.append(-1)
                        continue
                    got = seen.get((i, v))
                    if got is None:
                        if len(seen) > MAX_DICTIONARY:
                            seen.clear()
                        got = seen[i, v] = _codes(v, free[i])
                    code.append(len(got))
                    code += got
                out.append(np.array(code, np.int64))
            yield pd.DataFrame({"_key": b["_key"], "_tuple": out})

    rec = cut(src.mapInPandas(run, f"_key {dict(src.dtypes)['_key']}, _tuple array<long>"))
    groups = rec.groupBy("_tuple").agg(F.min("_key").alias("first_key"), F.count("*").alias("n_copies"))
    groups = cut(groups)
    salt = F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int")
    many = groups.where("n_copies > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    back = rec.withColumn("_salt", salt).join(many, ["_tuple", "_salt"]).select("first_key", F.col("_key").alias("copy_key"), "n_copies")
    single = groups.where("n_copies = 1").select("first_key", F.col("first_key").alias("copy_key"), "n_copies")
    return back.unionByName(single)
