"""The best value of every field among the records of one group."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SALTS = 16
CLOSING_SHARE = 0.5
#: Letters and digits that a stand-in may have, unless half of the group's longest text is fewer.
STAND_IN = 30
# What a cut text says at its end.
_MARKER = re.compile(
    r"(?:…|\.\.\.|[\[(<][^\])>]{0,30}(?:continued|missing|cut|next page|truncated|illegible)[^\])>]{0,30}[\])>]|--+\s*(?:see|continued|cut|page)[^\n]{0,40})[\s\u200b-\u200f\u2060\ufeff]*\Z", re.I
)
_PAGE = re.compile(r"[\W_]*(?:(?:page|pg?)[. ]*)?\d{1,4}(?:[ /-]+(?:of +)?\d{1,4})?(?:(?![.,;:%)])[\W_])*")
_SPACED = re.compile(r"(?:[^\W\d_] ){4}")
_SPACED_ASCII = re.compile(r"[A-Z] [A-Z] [A-Z] [A-Z] ")
_GAP = re.compile(r"[|\t]|\.\.\.|  ")
_HEADER = re.compile(r"(?:CHAPTER|Chapter|TITLE|Title) \d|\d{1,4} {3,}[^\W\d_]")
_TAIL_NO = re.compile(r" {3,}(?:\d{1,4}|\[[\d-]+\])\Z")
_MARKED = re.compile(r"\s*(?:[-*•–]\s+|\(?(?:\d{1,3}|[^\W\d_]|[ivxlIVXL]{1,6})[.)]\s+)")
_CELLS = re.compile(r"\S\s*(?:\||\t|\.{3,}| {2,})\s*\S")
_FIELD = re.compile(r"[^\W\d_](?:[^\W\d_]|[ \xa0/]){0,40}?\s*(?::|\s=|\s[–—-])\s*\S")
_FIELD_CUT = re.compile(r"\s*[;|]\s*|\s*\n\s*")
_CLOSED = re.compile(r"[.!?;][\s\u200b-\u200f\u2060\ufeff\"”’)]*\Z")
_ITEM = re.compile(r"[,;|][\s\u200b-\u200f\u2060\ufeff]*\Z")
_NOT_WORD = re.compile(r"[\W_]+")


def section_ok(section: Column) -> Column:
    """A number of three numeric parts with nothing but marks and white space around it."""
    return F.coalesce(section.rlike(r"^[^\p{L}\p{N}]*\p{Nd}+\.\p{Nd}+\.\p{Nd}+[^\p{L}\p{N}]*$"), F.lit(False))


def _line(x: str) -> tuple[bool, bool, bool, int]:
    """(page number or running header, marked entry, row of cells, letters and digits of an entry of any form) of one line."""
    spaced = bool(_SPACED_ASCII.search(x)) or not x.isascii() and any(m.group().isupper() for m in _SPACED.finditer(x))
    wall = spaced or bool(_PAGE.fullmatch(x))
    if not wall:
        m = _HEADER.match(x)
        wall = bool(m and (m.group()[0] in "CT" or m.group()[-1].isupper()) or x[:1].isupper() and _TAIL_NO.search(x))
    marked, cells = bool(_MARKED.match(x)), bool(_GAP.search(x) and _CELLS.search(x))
    return wall, marked, cells, len(_NOT_WORD.sub("", x)) if marked or cells or _FIELD.match(x) else 0


def features(text: str) -> tuple[str, bool, bool, bool, int, str, int, str]:
    """(canon, cut mark, closed, open item, entry, kind, size, end) of a content.

    canon: letters and digits in lower case without page furniture and the mark
    of a cut; entry: length of the last line, if it is an entry; size: number of
    fields, or letters; end: the last two words, numbers as 0.
    """
    every = text.split("\n")
    info = [_line(x) for x in every]
    bare = text if not any(f[0] for f in info) else "\n".join(x for x, f in zip(every, info) if not f[0])
    mark = _MARKER.search(text[-120:])
    uncut = text[: len(text) - len(mark.group())] if mark else text
    if mark:
        canon = _NOT_WORD.sub("", "\n".join(x for x in uncut.split("\n") if not _line(x)[0]).lower())
    else:
        canon = _NOT_WORD.sub("", bare.lower())
    last = next((f for x, f in zip(reversed(every), reversed(info)) if _NOT_WORD.sub("", x)), None)
    parts = [p for p in _FIELD_CUT.split(text) if p.strip()] if _FIELD.match(text.lstrip(" \t\r\n;|\xa0\u200b\ufeff")) else []
    n_lines = sum(bool(x.strip()) for x in every)
    if len(parts) > 1 and all(_FIELD.match(p.strip()) for p in parts):
        kind, n = "fields", len(parts)
    else:
        marked, cells = sum(f[1] for f in info), sum(f[2] and len(x) < 120 for x, f in zip(every, info))
        kind = "list" if marked * 2 > n_lines else "table" if cells * 2 > n_lines > 2 else "prose"
        n = len(canon)
    words = _NOT_WORD.sub(" ", bare[-200:].lower()).split()
    if len(words) < 3 and len(bare) > 200:
        words = _NOT_WORD.sub(" ", bare.lower()).split()
    end = re.sub(r"\d+", "0", " ".join(words[-2:]))
    return canon, bool(mark), bool(_CLOSED.search(bare[-60:])), bool(_ITEM.search(text[-60:])), last[3] if last else 0, kind, n, end


def salted(rows: DataFrame, groups: DataFrame, group: str, salt_of: str, salts: int = SALTS) -> DataFrame:
    """Left join of rows with one row per group, spread over ``salts`` tasks per group."""
    g = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(salts)).cast("int")).join(g, [group, "_salt"], "left").drop("_salt")


def next_in_group(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """The next larger value of the group, by one range sort; no task holds a whole group.

    (group, value) must be distinct.  The first row of the next partition is
    brought to the last row of each by a table of one row per partition.
    """
    d = cut(df.repartitionByRange(F.col(group), F.col(value)).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p").orderBy(group, value)
    d = d.withColumn("_ng", F.lead(group).over(w)).withColumn("_nv", F.lead(value).over(w)).withColumn("_last", F.lead("_p").over(w).isNull())
    first = d.groupBy("_p").agg(F.min(F.struct(F.col(group).alias("g"), F.col(value).alias("v"))).alias("_f"))
    after = first.select("_p", F.lead("_f").over(Window.partitionBy(F.lit(0)).orderBy("_p")).alias("_nf"))
    d = d.join(after, "_p")
    ng, nv = F.when(F.col("_last"), F.col("_nf.g")).otherwise(F.col("_ng")), F.when(F.col("_last"), F.col("_nf.v")).otherwise(F.col("_nv"))
    return d.withColumn(out, F.when(ng.eqNullSafe(F.col(group)), nv)).drop("_p", "_ng", "_nv", "_last", "_nf")


_STOP = re.compile(r"[.!?;](?=[\s\u200b-\u200f\u2060\ufeff\"”’)])")
_DIGITS = re.compile(r"\d+")


_NUL = "\x00"
_NOT_KEPT = re.compile(r"[^\w\x00]+|_+")
_NULS = re.compile(r"\s*\x00[\s\x00]*")


def closing_words(text: str) -> list[str]:
    """The words of a text in lower case, numbers as 0; one that closes a sentence ends in a zero character."""
    t = _STOP.sub(_NUL, _DIGITS.sub("0", text.lower()) + " ")
    return _NULS.sub(_NUL + " ", _NOT_KEPT.sub(" ", t)).strip(" ").split()


def _closing_shares(texts: DataFrame, text: str, ends: DataFrame) -> DataFrame:
    """(_end, _share): of the places of a word pair in the texts, the share that closes a sentence.

    ``ends`` holds the distinct pairs asked for.  An end of a text without a mark
    is no place, nor is a pair over the end of a sentence.  Every task counts its own places first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def flush() -> pd.DataFrame:
            sums: dict[str, list[int]] = {}
            for (v, w), n in seen.items():
                if v[-1] != _NUL:
                    last = w[-1] == _NUL
                    got = sums.setdefault(f"{v} {w[:-1] if last else w}", [0, 0])
                    got[0] += n
                    got[1] += n * last
            seen.clear()
            return pd.DataFrame([(k, *v) for k, v in sums.items()], columns=["_end", "_n", "_last"])

        for b in batches:
            for t in b["t"]:
                ws = closing_words(t)
                n = len(ws) if ws and ws[-1][-1] == _NUL else len(ws) - 1
                seen.update(zip(ws[: max(0, n - 1)], ws[1 : max(0, n)]))
                if len(seen) > 50_000:
                    yield flush()
        yield flush()

    pairs = texts.select(F.col(text).alias("t")).mapInPandas(run, "_end string, _n long, _last long")
    return pairs.join(ends, "_end", "left_semi").groupBy("_end").agg((F.sum("_last") / F.sum("_n")).alias("_share"))


def whole_content(df: DataFrame, key: str, group: str, content: str) -> DataFrame:
    """(key, group, whole): whether a content holds its group's whole text in any wording.

    Not whole are: null, blank and stand-in contents (fewer than STAND_IN letters
    and digits, and fewer than half of the group's longest text); contents with a mark of being cut at their end; contents
    that continue in another row of the group (their letters and digits begin a
    longer one by more than a few, or than a short closed note behind a closed text or a
    complete entry) or lack a stretch before their end (same last letters, clearly
    shorter than the longest that ends so); running text without a closing mark, unless the same letters
    stand with one elsewhere in the group, or its last two words close a text of the
    group or at least half of their places in all texts, and its length is that of the group's closed text, if it has one; ``Key: value`` contents with fewer fields, and lists and tables
    with clearly fewer characters, than the fullest of the group.

    Every bound is a share inside the group or of a word pair's own places, so
    rows of other groups change a result only through how word pairs close.
    """
    c = F.col(content)
    src = df.where(c.isNotNull() & F.col(group).isNotNull()).select(F.col(key).alias("_k"), F.col(group).alias("_g"), c.alias("_c"))
    kinds = dict(src.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["_canon", "_cutmark", "_closed", "_item", "_entry", "_kind", "_n", "_end"]
        for b in batches:
            for lo in range(0, len(b), 2000):
                part = b.iloc[lo : lo + 2000]
                f = pd.DataFrame([features(t) for t in part["_c"]], columns=names)
                yield pd.concat([part[["_k", "_g"]].reset_index(drop=True), f], axis=1)

    schema = f"_k {kinds['_k']}, _g {kinds['_g']}, _canon string, _cutmark boolean, _closed boolean, _item boolean, _entry int, _kind string, _n int, _end string"
    x = src.mapInPandas(run, schema).where("_canon <> ''")
    x = x.withColumn("_len", F.length("_canon")).withColumn("_tail", F.xxhash64(F.right("_canon", F.lit(24))))
    x = cut(x.withColumn("_h", F.xxhash64("_canon")))
    tails = x.where("not _cutmark").groupBy("_g", "_tail").agg(F.max("_len").alias("_full"))
    x = x.join(tails, ["_g", "_tail"], "left")
    x = x.withColumn("_gap", (F.col("_kind") == "prose") & F.coalesce(F.col("_len") < 0.92 * F.col("_full"), F.lit(False)))
    of = lambda k: F.max(F.when(F.col("_kind") == k, F.col("_n")))
    closed_len = F.max(F.when((F.col("_kind") == "prose") & F.col("_closed") & ~F.col("_cutmark") & ~F.col("_gap"), F.col("_len")))
    top = x.groupBy("_g").agg(of("fields").alias("_tf"), of("list").alias("_tl"), of("table").alias("_tt"), closed_len.alias("_tp"), F.max("_len").alias("_most"))
    forms = x.groupBy("_g", "_canon").agg(
        F.max("_closed").alias("_any_closed"),
        F.max("_item").alias("_any_item"),
        F.max(F.col("_closed") & ~F.col("_cutmark")).alias("_sound"),
        F.max("_entry").alias("_entry"),
    )
    forms = next_in_group(forms, "_g", "_canon", "_next")
    follows = F.col("_next").startswith(F.col("_canon"))
    forms = forms.withColumn("_more", F.when(follows, F.length("_next") - F.length("_canon")).otherwise(0)).withColumn("_hn", F.when(follows, F.xxhash64("_next")))
    forms = cut(forms.withColumn("_h", F.xxhash64("_canon")).drop("_canon", "_next"))
    after = forms.where("_sound").select("_g", F.col("_h").alias("_hn"), F.col("_entry").alias("_entry_next"))
    forms = forms.join(after, ["_g", "_hn"], "left")
    note = F.col("_more").between(3, 40) & F.coalesce(F.col("_entry_next") != F.col("_more"), F.lit(False)) & (F.col("_any_closed") | F.col("_any_item"))
    forms = forms.select("_g", "_h", "_any_closed", F.when(note, 0).otherwise(F.col("_more")).alias("_more"))
    ends = x.where("_kind = 'prose' and _closed and not _cutmark").groupBy("_g", "_end").agg(F.lit(True).alias("_end_closed"))
    y = x.join(forms, ["_g", "_h"]).join(ends, ["_g", "_end"], "left")
    open_ends = y.where("_kind = 'prose' and not _cutmark and not _any_closed and _end_closed is null").select("_end").distinct()
    y = y.join(_closing_shares(df.where(c.isNotNull() & F.col(group).isNotNull()), content, open_ends), "_end", "left")
    y = y.withColumn("_known_end", F.coalesce("_end_closed", F.col("_share") >= CLOSING_SHARE, F.lit(False)))
    y = salted(y, top, "_g", "_k")
    short = F.col("_gap") | (
        F.when(F.col("_kind") == "fields", F.col("_n") < F.col("_tf"))
        .when(F.col("_kind") == "list", (F.col("_n") < 0.9 * F.col("_tl")) & (F.col("_tl") - F.col("_n") > 30))
        .when(F.col("_kind") == "table", (F.col("_n") < 0.9 * F.col("_tt")) & (F.col("_tt") - F.col("_n") > 30))
        .otherwise(~F.col("_any_closed") & ~(F.col("_known_end") & (F.col("_tp").isNull() | (F.col("_tp") < 0.5 * F.col("_most")) | F.col("_len").between(0.92 * F.col("_tp"), 1.08 * F.col("_tp")))))
    )
    whole = ~F.col("_cutmark") & ~short & ((F.col("_more") <= 2) | (F.col("_more") <= 15) & (F.col("_closed") | (F.col("_kind") == "fields")))
    whole = whole & (F.col("_len") >= F.least(F.lit(float(STAND_IN)), 0.5 * F.col("_most")))
    got = y.select("_k", "_g", whole.alias("whole"))
    return got.select(F.col("_k").alias(key), F.col("_g").alias(group), "whole")


def survivors(df: DataFrame, key: str, group: str, fields_ok: dict[str, str], trust: str, time: str) -> DataFrame:
    """(group, field_name, key, value, n_rows): of every group of two or more rows and every field the surviving value.

    One aggregation takes, per field, the maximum of (can survive, trust, time,
    key, value); it combines on the map side, so a hot group sends one row per
    task.  ``fields_ok`` names for each field the boolean column that says
    whether the row's value can survive.  Missing trust or time ranks lowest.
    Groups where no value can survive, null groups and single rows give no row.
    """
    best = [
        F.max(F.when(F.col(ok), F.struct(F.coalesce(F.col(trust), F.lit(-1)).alias("t"), F.col(time).alias("l"), F.col(key).alias("k"), F.col(f).alias("v")))).alias(f"_{f}")
        for f, ok in fields_ok.items()
    ]
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n_rows"), *best).where("n_rows > 1")
    parts = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"_{f}.k").alias("k"), F.col(f"_{f}.v").alias("v")) for f in fields_ok])
    out = g.select(group, "n_rows", F.explode(parts).alias("_e")).where("_e.k is not null")
    return out.select(group, "_e.field_name", F.col("_e.k").alias(key), F.col("_e.v").alias("value"), "n_rows")
