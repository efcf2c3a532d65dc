"""Lines repeated across the documents of one source, by template trees."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

MIN_ROWS, MIN_SHARE = 5, 0.02
FLUSH = 100_000
MAX_BROADCAST_LEAVES = 200_000
SLOT = "<*>"


def squeeze(line: Column) -> Column:
    """A line without white space of any kind, invisible characters and digits, in lower case."""
    return F.regexp_replace(F.lower(line), r"[\s\p{Z}\p{Cf}\p{Cc}\p{Nd}]+", "")


def tidy(line: Column) -> Column:
    """A line without invisible characters, its tokens parted by single spaces as Python's split parts them."""
    seen = F.regexp_replace(line, r"[\p{Cf}\p{Cc}&&[^\s\x1c-\x1f\x85]]+", "")
    return F.trim(F.regexp_replace(seen, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def _lines(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(source, key, line, line_no, sq): the lines that have a letter, as they are and squeezed."""
    d = df.where(F.col(source).isNotNull() & F.col(text).isNotNull())
    x = d.select(F.col(source).alias("_source"), F.col(key).alias("_key"), F.posexplode(F.split(F.col(text), "\n")).alias("_pos", "_line"))
    return x.select("_source", "_key", "_line", (F.col("_pos") + 1).alias("line_no"), squeeze(F.col("_line")).alias("_sq")).where(F.col("_sq").rlike(r"\p{L}"))


def _path(sq: Column, depth: int) -> Column:
    """Place of a line in the token tree of its source that no spacing or digit
    can change: the number of letter runs of the squeezed line, then its first runs."""
    toks = F.split(sq, r"[^\p{L}]+")
    return F.xxhash64(F.size(toks), F.slice(toks, 1, depth))


class TokenTree:
    """Fixed-depth tree: source, number of tokens, first token; a leaf holds templates of tokens and wildcard slots.

    A line joins the template of its leaf with which most of its tokens agree,
    if that share, slots counting half, is at least ``alike``; slots open where they differ.  Tokens with
    a digit are slots from the start.  A leaf holds as many templates as its lines need.
    """

    def __init__(self, alike: float = 0.6):
        self.alike, self.leaves, self.templates = alike, {}, []

    @staticmethod
    def tokens(line: str) -> list[str]:
        return [SLOT if any(c.isdigit() for c in t) else t for t in line.lower().split()]

    def add(self, source, toks: list[str]) -> list:
        """The template, a list of tokens that later lines may open further."""
        return self.templates[self.number(source, toks)]

    def number(self, source, toks: list[str]) -> int:
        """The number of the template, which stays when slots open."""
        places, by_slots, equal = self.leaves.setdefault((source, len(toks), toks[0] if toks else ""), ({}, {}, {}))
        slots = toks.count(SLOT)
        if not toks or (len(toks) - slots / 2) / len(toks) < self.alike:
            # so many slots that only an equal line can be alike
            n = equal.setdefault(tuple(toks), len(self.templates))
            if n == len(self.templates):
                self.templates.append([sys.intern(t) for t in toks])
            return n
        n = self._best(places, by_slots, toks)
        if n is None:
            n = len(self.templates)
            self.templates.append([sys.intern(t) for t in toks])
            self._index(places, by_slots, n, slots)
            return n
        x = self.templates[n]
        differ = [i for i, (a, b) in enumerate(zip(x, toks)) if a != b and a != SLOT]
        if differ:
            slots = x.count(SLOT)
            self._index(places, by_slots, n, slots, gone=True)
            for i in differ:
                x[i] = SLOT
            self._index(places, by_slots, n, slots + len(differ))
        return n

    def _index(self, places: dict, by_slots: dict, n: int, slots: int, gone: bool = False) -> None:
        """Enter a template with its number of slots, or take it out; a place with one template holds its bare number."""
        if gone:
            by_slots[slots].discard(n)
        else:
            by_slots.setdefault(slots, set()).add(n)
        for i, t in enumerate(self.templates[n]):
            if i and t != SLOT:
                at = (slots, i, t)
                had = places.get(at)
                if gone:
                    if isinstance(had, set) and len(had) > 1:
                        had.discard(n)
                    else:
                        del places[at]
                elif had is None:
                    places[at] = n
                elif isinstance(had, set):
                    had.add(n)
                else:
                    places[at] = {had, n}

    def _best(self, places: dict, by_slots: dict, toks: list[str]) -> int | None:
        """The most alike template, the first of equals.

        All templates of a leaf agree in the first token.  Of those with a given number of slots, one that is
        alike enough agrees in at least ``least`` other places; so it shares one of all but ``least`` - 1 of the
        line's places, or two of all but ``least`` - 2, and the rarest places find it.
        """
        n, first = len(toks), toks[0] != SLOT
        literal = [(i, t) for i, t in enumerate(toks) if i and t != SLOT]
        best, score = None, self.alike
        for slots, held in by_slots.items():
            least = math.ceil(score * n - slots / 2 - first - 1e-9)
            if not held or least > min(len(literal), n - slots - first):
                continue
            if least <= 0:
                some = held
            else:
                sets = sorted((x if isinstance(x, set) else {x} for x in (places.get((slots, i, t)) for i, t in literal) if x is not None), key=len)
                if len(sets) < least:
                    continue
                # of the sets that are there, as many may be missed as of all places
                sets = sets[: len(sets) - least + min(least, 2)]
                some = set().union(*sets) if least == 1 else set().union(*(x & y for i, x in enumerate(sets) for y in sets[i + 1 :]))
            for c in some:
                got = sum(1.0 if a == b and a != SLOT else 0.5 if a == SLOT else 0.0 for a, b in zip(self.templates[c], toks)) / n
                if got > score or got == score and (best is None or c < best):
                    best, score = c, got
        return best


def parse_templates(lines: DataFrame, source: str, line: str, n: str, alike: float = 0.6) -> DataFrame:
    """``lines`` with template and covered: each line's template and the sum of ``n`` over its lines.

    Every task parses its own lines into trees, FLUSH lines at a time; the
    templates of all trees, not the lines, are then brought together by leaf,
    the most frequent first, and parsed once more, which merges equal and
    similar ones.  A task holds all templates of one leaf; what became of each
    is told when the leaf is through, with all its slots.
    """
    cols = [c for c in lines.columns]
    fields = ", ".join(f"`{c}` {t}" for c, t in lines.dtypes)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tree, size = [], TokenTree(alike), 0

        def done() -> Iterator[pd.DataFrame]:
            for b, ts in held:
                yield b.assign(_local=pd.Series([" ".join(t) for t in ts], dtype=object, index=b.index))

        for b in batches:
            for lo in range(0, len(b), 5000):
                part = b.iloc[lo : lo + 5000]
                held.append((part, [tree.add(s, TokenTree.tokens(x)) for s, x in zip(part[source], part[line])]))
                size += len(part)
            if size > FLUSH:
                yield from done()
                held, tree, size = [], TokenTree(alike), 0
        yield from done()

    parsed = cut(lines.mapInPandas(local, f"{fields}, _local string"))
    leaf = F.xxhash64(source, F.size(F.split("_local", " ")), F.substring_index("_local", " ", 1))
    every = parsed.groupBy(source, "_local").agg(F.sum(n).alias("_sum")).withColumn("_leaf", leaf)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows with _local name the number of its template, rows without it are the templates
        columns, last, tree, about = ["_s", "_leaf", "_no", "_local", "template", "covered"], None, TokenTree(alike), []

        def done() -> Iterator[pd.DataFrame]:
            covered: dict = {}
            for (s, k), t in zip(about, tree.templates):
                name = s, " ".join(t)
                covered[name] = covered.get(name, 0) + k
            for lo in range(0, len(about), 5000):
                names = [(s, " ".join(t)) for (s, _), t in zip(about[lo : lo + 5000], tree.templates[lo : lo + 5000])]
                yield pd.DataFrame([(s, last, lo + i, None, t, covered[s, t]) for i, (s, t) in enumerate(names)], columns=columns)

        for b in batches:
            rows = []
            for s, x, k, at in zip(b[source], b["_local"], b["_sum"], b["_leaf"]):
                if at != last:
                    yield from done()
                    tree, last, about = TokenTree(alike), at, []
                no = tree.number(s, x.split(" "))
                if no == len(about):
                    about.append([s, 0])
                about[no][1] += k
                rows.append((s, at, no, x, None, 0))
            yield pd.DataFrame(rows, columns=columns)
        yield from done()

    st = dict(lines.dtypes)[source]
    merged = every.repartition(F.col("_leaf")).sortWithinPartitions("_leaf", F.desc("_sum"), "_local").mapInPandas(merge, f"_s {st}, _leaf long, _no long, _local string, template string, covered long")
    merged = cut(merged)
    ends = merged.where("_local IS NULL").drop("_local")
    names = merged.where("_local IS NOT NULL").drop("template", "covered").join(ends, ["_s", "_leaf", "_no"]).drop("_leaf", "_no").withColumnRenamed("_s", source)
    return parsed.join(names, [source, "_local"]).select(*cols, "template", "covered")


def _needed(df: DataFrame, source: str, text: str, min_rows: int, min_share: float) -> DataFrame:
    rows = df.where(F.col(source).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("_n"))
    return cut(rows.select("_source", F.greatest(F.lit(float(min_rows)), F.col("_n") * F.lit(min_share)).alias("_need")))


def _frequent(lines: DataFrame, need: DataFrame, leaf: Column) -> DataFrame:
    """The lines whose leaf holds at least as many lines as a template needs."""
    lines = lines.withColumn("_leaf", leaf)
    tree = cut(lines.groupBy("_source", "_leaf").agg(F.count("*").alias("_c")).join(need, "_source").where("_c >= _need").select("_source", "_leaf"))
    # the counted leaves go to every task while they are few; else both sides meet by leaf
    return lines.join(F.broadcast(tree) if tree.count() <= MAX_BROADCAST_LEAVES else tree, ["_source", "_leaf"])


def site_lines(df: DataFrame, key: str, source: str, text: str, *, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, depth: int = 2) -> DataFrame:
    """(key, source, line_no, template_id): every line that its source repeats excessively.

    1. Each partition counts the leaves of a fixed-depth token tree per source;
       the trees merge in one aggregation whose map side is that partition-local
       tree.  Leaves that hold fewer lines than the threshold are pruned: a leaf
       counts every line of every template in it, so nothing that is repeated
       enough is lost.  At most (lines per row / min_share) leaves per source survive.
    2. Lines of the surviving leaves are counted by their whole squeezed text
       (128-bit fingerprint) over distinct rows, and one spelling of each is
       parsed into templates with wildcard slots (``parse_templates``).
    3. Templates that cover enough rows are kept, and of their lines, as the
       exact check of the same-line rule, those that by themselves stand in at
       least ``min_rows`` rows and ``min_share`` of the source's rows with text.

    Null sources or texts and lines without a letter never count; empty tables
    give no rows.  Repeated lines of one row count once towards the threshold
    and are all returned.  Counts are partial aggregates, so a hot source is
    spread over all tasks.
    """
    need = _needed(df, source, text, min_rows, min_share)
    kept = _frequent(_lines(df, key, source, text), need, _path(F.col("_sq"), depth))
    kept = cut(kept.select("_source", "_key", "line_no", "_line", F.xxhash64("_sq").alias("_t1"), F.xxhash64(F.lit(1), "_sq").alias("_t2")))
    once = kept.groupBy("_source", "_t1", "_t2", "_key").agg(F.min("_line").alias("_line"))
    same = once.groupBy("_source", "_t1", "_t2").agg(F.count("*").alias("_c"), F.min("_line").alias("_line"))
    parsed = parse_templates(same, "_source", "_line", "_c").join(need, "_source")
    found = parsed.where("covered >= _need").where("_c >= _need").select("_source", "_t1", "_t2")
    out = kept.drop("_line").join(found, ["_source", "_t1", "_t2"])
    return out.select(F.col("_key").alias(key), F.col("_source").alias(source), "line_no", F.col("_t1").alias("template_id"))


def site_templates(df: DataFrame, key: str, source: str, text: str, *, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, alike: float = 0.6) -> DataFrame:
    """(source, template, n_rows, n_lines): templates that cover many rows of a source, <*> where their lines differ.

    Unlike ``site_lines``, lines with a varying word, such as bylines, form one
    template.  Lines that are the same but for white space, digits and case are
    one line, in its most frequent leaf of (number of tokens, first token);
    leaves whose lines all together stay below the threshold are pruned.
    n_rows adds up, over the distinct lines of the template, the rows that have
    them, n_lines counts those lines.
    """
    need = _needed(df, source, text, min_rows, min_share)
    lines = _lines(df, key, source, text).withColumn("_line", tidy(F.col("_line")))
    toks = F.split("_line", " ")
    first = F.lower(toks[0])
    # any number sign: at least what TokenTree takes for a digit
    leaf = F.xxhash64(F.size(toks), F.when(first.rlike(r"\p{N}"), F.lit(SLOT)).otherwise(first))
    lines = lines.select("_source", "_key", "_line", leaf.alias("_leaf"), F.xxhash64("_sq").alias("_t1"), F.xxhash64(F.lit(1), "_sq").alias("_t2"))
    line = ["_source", "_t1", "_t2"]
    spelt = lines.groupBy(*line, "_leaf").agg(F.count("*").alias("_c"))
    # a line counts whole in one leaf before leaves are pruned, so no spelling of it is lost
    homes = cut(spelt.groupBy(*line).agg(F.sum("_c").alias("_c"), F.max(F.struct("_c", "_leaf"))["_leaf"].alias("_home")))
    tree = homes.groupBy("_source", "_home").agg(F.sum("_c").alias("_n")).join(need, "_source").where("_n >= _need").select("_source", "_home")
    homes = cut(homes.drop("_c").join(tree, ["_source", "_home"]))
    kept = lines.join(F.broadcast(homes) if homes.count() <= MAX_BROADCAST_LEAVES else homes, line)
    once = kept.groupBy(*line, "_key").agg(F.min(F.when(F.col("_leaf") == F.col("_home"), F.col("_line"))).alias("_line"))
    same = once.groupBy(*line).agg(F.count("*").alias("_c"), F.min("_line").alias("_line"))
    x = parse_templates(same, "_source", "_line", "_c", alike).join(need, "_source").where("covered >= _need")
    return x.groupBy(F.col("_source").alias(source), "template").agg(F.max("covered").alias("n_rows"), F.count("*").alias("n_lines"))


def remove_site_lines(df: DataFrame, key: str, source: str, text: str, **how) -> DataFrame:
    """``df`` with the repeated lines cut out of ``text``, and n_lines_removed.

    Only line numbers meet at a key (at most as many as the document has
    lines); the text itself is not shuffled for counting, and all columns,
    whatever their names, and all rows stay.  ``key`` must be unique.
    """
    gone = site_lines(df, key, source, text, **how).groupBy(F.col(key).alias("_gone_key")).agg(F.collect_set("line_no").alias("_gone"))
    j = df.join(gone, F.col(key) == F.col("_gone_key"), "left")
    parts = F.split(F.col(text), "\n")
    kept = F.filter(F.transform(parts, lambda v, i: F.struct((i + 1).alias("i"), v.alias("v"))), lambda s: ~F.array_contains(F.col("_gone"), s["i"]))
    clean = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda s: s["v"]), "\n"))
    return j.withColumn(text, clean).withColumn("n_lines_removed", F.coalesce(F.size("_gone"), F.lit(0))).drop("_gone", "_gone_key")
