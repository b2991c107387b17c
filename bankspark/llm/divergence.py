"""How the sources of a language differ in the words they use.

Words are counted once; the counts of a language are a sparse matrix with a row per source and a column per word.
Every two sources are compared by walking the K-squared quadtrees of their blocks of rows together: a quadrant
where both have no count has one price, its number of columns times the gap of the two prices without a count.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from bankspark.llm.quadtree import SIDE, Quadtree, gap, pair_gaps, price
from bankspark.llm.store import new_folder, stored
from bankspark.llm.words import slices, texts
from bankspark.operators.ordering import global_positions

LEAST_DOCUMENTS, BEST_TERMS = 3, 200
# Columns of the matrix that one task takes at a time.
SLICE = 128 * SIDE
# Counts that a task holds, and from how many occurrences on it holds them until its end.
COUNTED_AT_ONCE, FREQUENT = 500_000, 8
# Up to so many groups (a row of some 50 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

# A-Z in lower case; what is no letter and no byte of a longer character separates terms.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _counted(batches):
    """Occurrences and documents of each term by language and source."""
    times: dict[tuple, Counter] = {}
    documents: dict[tuple, Counter] = {}

    def rows(most: int | None = None):
        """Counts up to ``most`` go out; higher ones are added to, so that frequent terms are a row a task."""
        for (lang, source), of in times.items():
            out = [t for t, n in of.items() if most is None or n <= most]
            docs = documents[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang, pa.string()), len(out)), pa.repeat(pa.scalar(source, pa.string()), len(out)),
                 pa.array(out, pa.binary()).cast(pa.string()), pa.array([of.pop(t) for t in out], pa.int64()),
                 pa.array([docs.pop(t) for t in out], pa.int64())],
                ["lang", "source", "term", "n", "docs"])
        if most is None or sum(map(len, times.values())) > COUNTED_AT_ONCE // 2:
            if most is not None:
                yield from rows()
            times.clear()
            documents.clear()

    for batch in slices(batches):
        for text, *group in zip(texts(batch.column("text")), batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
            each = terms(text)
            times.setdefault(tuple(group), Counter()).update(each)
            documents.setdefault(tuple(group), Counter()).update(set(each))
        if sum(map(len, times.values())) > COUNTED_AT_ONCE:
            yield from rows(FREQUENT)
    yield from rows()


def _numbered(batches):
    """Numbers the terms of each language from 0 in the order they come in; terms that follow each other are one."""
    part, lang, term, number = TaskContext.get().partitionId(), None, None, -1
    for batch in batches:
        if batch.num_rows == 0:
            continue
        languages, words = (pa.concat_arrays([pa.array([x], pa.string()), batch.column(c)]) for x, c in ((lang, "lang"), (term, "term")))
        # The first row of all follows no other: null is unlike every name.
        other = lambda x: pc.fill_null(pc.not_equal(x[1:], x[:-1]), True).to_numpy(zero_copy_only=False)
        new_lang = other(languages)
        new_term = new_lang | other(words)
        counted = np.cumsum(new_term)
        starts = np.flatnonzero(new_lang)
        run = np.cumsum(new_lang)
        base = np.concatenate(([number], -counted[starts]))[run]
        numbers = counted + base
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(part, pa.int32()), batch.num_rows), *(batch.column(c) for c in ("lang", "term", "source", "n", "of_lang")),
             pa.array(numbers.astype(np.int64))],
            ["part", "lang", "term", "source", "n", "of_lang", "place"])
        lang, term, number = languages[-1].as_py(), words[-1].as_py(), int(numbers[-1])


def _priced(n: str | Column, total: str | Column) -> Column:
    """``price`` as an expression."""
    n, total = (F.col(x) if isinstance(x, str) else x for x in (n, total))
    rest, out = n + 1, F.lit(0).cast("bigint")
    for _ in range(3):
        out = out * 1000 + _div(rest * 1000, total)
        rest = (rest * 1000) % total
    return out + 1


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def _units(batches):
    """Header and cells of each (lang, block, other, slice), whose rows follow each other."""
    key, held = None, []
    names = ["lang", "block", "other", "slice"]
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(c) for c in names]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *np.flatnonzero(new), batch.num_rows]
        for i, j in zip(edges[:-1], edges[1:]):
            mine = tuple(c[i].as_py() for c in columns)
            if mine != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = mine
            held.append(batch.slice(i, j - i))
    if held:
        yield key, pa.Table.from_batches(held)


def _compared(width: int):
    def compared(batches):
        for (lang, block, other, number), rows in _units(batches):
            header = json.loads(rows.column("header")[0].as_py())
            same = block == other
            cells = rows.slice(1)
            side, row, column, n = (cells.column(c).to_numpy() for c in ("side", "row", "column", "n"))
            totals = [np.array(header["totals"], np.int64), np.array(header["other_totals"], np.int64)]
            empty = [price(np.zeros(len(t), np.int64), t) for t in totals]
            trees = []
            for k in (0,) if same else (0, 1):
                at = np.flatnonzero(side == k)
                of = price(n[at], totals[k][row[at]])
                trees.append(Quadtree(column[at] // SIDE, row[at].astype(np.int64), column[at] % SIDE, of))
            trees = trees * 2 if same else trees
            tiles = np.unique(column // SIDE)
            columns = np.minimum(header["v"] - tiles * SIDE, SIDE)
            rows_of = (len(totals[0]), len(totals[1]))
            sums = pair_gaps(*trees, rows_of, tuple(empty), tiles, columns, same)
            one, back, blank = (x[: rows_of[0], : rows_of[1]] for x in sums)
            # Tiles that neither block has a count in are blank as a whole.
            whole = max(0, min(header["v"] - number * width, width))
            blank = blank + (whole - int(columns.sum()))
            one = one + blank * gap(empty[0][:, None], empty[1][None, :])
            back = back + blank * gap(empty[1][None, :], empty[0][:, None])
            x, y = np.triu_indices(rows_of[0], 1) if same else (z.ravel() for z in np.indices(rows_of))
            mine, its = np.array(header["names"], object)[x], np.array(header["other_names"], object)[y]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang, pa.string()), 2 * len(x)), pa.array([*mine, *its], pa.string()), pa.array([*its, *mine], pa.string()),
                 pa.array(np.concatenate((one[x, y], back[x, y])))],
                ["lang", "source", "item", "value"])

    return compared


def _known(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """``rows`` with what is known of their source."""
    return rows.join(F.broadcast(groups) if n_groups <= BROADCAST_ROWS else groups, ["lang", "source"])


def source_divergence(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, best: int = BEST_TERMS, width: int = SLICE
) -> DataFrame:
    """Per source of each language, how its words differ: ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    ``docs`` needs ``text``, ``lang`` and ``source``, where null counts as ''; other columns are left out. Terms are runs
    of letters A-Z, a-z and characters beyond ASCII, A-Z in lower case. A language keeps its terms of at least ``least``
    rows. A term of n occurrences in a source has the price p = 1 + floor(10**9 * (n + 1) / (N + V)), for N occurrences
    of V kept terms; the gap of p from q is floor((p - q)**2 / q). Part ``pair``: every other source of the
    language, with the sum over all kept terms of the gaps from it. Part ``term``: the ``best`` terms of the source
    with a price above the whole language's, with their gap from it. Ranks go by value, then by the bytes of the
    item. Rows without text, with one source or without kept terms make sources too; a source that is alone has no
    pairs. Repeated rows are documents of their own; an empty table gives no rows. Exact for up to 9 * 10**15
    occurrences and 8 * 10**9 kept terms of a language.
    """
    if width % SIDE:
        raise ValueError(f"width must be a multiple of {SIDE}")
    folder = new_folder(docs.sparkSession, "divergence")
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(filled("lang"), filled("source"), "text")
    # Tasks have added up what they counted; a term's rows go to one task, for its sources and for the whole language.
    counted = docs.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    counts = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = counts.select("*", F.sum("n").over(of_term).alias("of_lang"), F.sum("docs").over(of_term).alias("in_docs")).filter(
        F.col("in_docs") >= least)
    cells = stored(
        kept.select("lang", "term", "source", "n", "of_lang").mapInArrow(
            _numbered, "part int, lang string, term string, source string, n bigint, of_lang bigint, place bigint"),
        folder, "cells")
    # Terms are numbered in each partition; the columns of a partition follow those of the ones before.
    parts = cells.groupBy("lang", "part").agg((F.max("place") + 1).alias("terms"), F.sum("n").alias("n"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.withColumn("start", F.coalesce(F.sum("terms").over(before), F.lit(0))), folder, "parts")
    of_lang = parts.groupBy("lang").agg(F.sum("terms").alias("v"), F.sum("n").alias("lang_n"))
    # All sources, in order; a block has SIDE of them.
    places = global_positions(docs.select("lang", "source").distinct(), ["lang", "source"])
    first = places.groupBy("lang").agg(F.min("position").alias("first"))
    zero = F.lit(0).cast("bigint")
    groups = stored(
        places.join(first, "lang").join(of_lang, "lang", "left")
        .join(cells.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
        .select(
            "lang", "source", (F.col("position") - F.col("first")).alias("at"), F.coalesce("v", zero).alias("v"),
            F.coalesce("lang_n", zero).alias("lang_n"), F.greatest(F.coalesce("n", zero) + F.coalesce("v", zero), F.lit(1)).alias("total"))
        .withColumn("block", F.expr(f"at div {SIDE}")).withColumn("row", (F.col("at") % SIDE).cast("int")),
        folder, "groups")
    n_groups = groups.count()
    blocks = stored(
        groups.groupBy("lang", "block", "v").agg(F.sort_array(F.collect_list(F.struct("row", "total", "source"))).alias("rows")).select(
            "lang", "block", "v", F.col("rows.total").alias("totals"), F.col("rows.source").alias("names")),
        folder, "blocks")
    others = blocks.select("lang", F.col("block").alias("other"), F.col("totals").alias("other_totals"), F.col("names").alias("other_names"))
    last = blocks.groupBy("lang").agg(F.max("block").alias("last"))
    slices_of = F.greatest(F.expr(f"(v - 1) div {width}"), zero)
    # Both blocks' sources in one text; arrays that are null in all other rows would be slow to hand over.
    header = F.to_json(F.struct("v", "totals", "names", "other_totals", "other_names")).alias("header")
    headers = (
        blocks.join(last, "lang").withColumn("other", F.explode(F.sequence("block", "last"))).join(others, ["lang", "other"])
        .select("lang", "block", "other", F.explode(F.sequence(zero, slices_of)).alias("slice"), F.lit(0).alias("turn"), header))
    known = _known(cells, groups.select("lang", "source", "block", "row", "total", "v", "lang_n"), n_groups)
    small = parts.count() <= BROADCAST_ROWS
    starts = parts.select("lang", "part", "start")
    placed = known.join(last, "lang").join(F.broadcast(starts) if small else starts, ["lang", "part"]).withColumn(
        "column", F.col("start") + F.col("place"))
    # A cell goes to every other block of its language, as the first or the second of the two.
    sent = placed.withColumn("met", F.explode(F.sequence(zero, "last"))).select(
        "lang", F.least("block", "met").alias("block"), F.greatest("block", "met").alias("other"),
        F.expr(f"column div {width}").alias("slice"), F.lit(1).alias("turn"),
        (F.col("block") > F.col("met")).cast("int").alias("side"), "row", "column", "n")
    key = ["lang", "block", "other", "slice"]
    ordered = headers.unionByName(sent, allowMissingColumns=True).repartition(*key).sortWithinPartitions(*key, "turn")
    gaps = ordered.select(*key, "header", "side", "row", "column", "n").mapInArrow(
        _compared(width), "lang string, source string, item string, value bigint")
    pairs = gaps.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    p, q = _priced("n", "total"), _priced("of_lang", F.col("lang_n") + F.col("v"))
    above = known.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    words = above.select("lang", "source", "item", _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    best_words = words.select("*", rank).filter(F.col("rank") <= best).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select("*", rank).select(columns).unionByName(best_words.select(columns))
