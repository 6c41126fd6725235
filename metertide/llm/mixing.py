"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source gets a share of all words by weight, capped at ``epochs`` times its own size; what is
cut off goes to the others by weight. The shares are cut into blocks of ``block_words`` words. Whole
blocks are allotted to sources, and within a source to its shards, one after the other to the
highest quotient ``weight / (2 * seats + 1)``. A shard's documents lie in seeded order, as one
stream of words cut into blocks; its quota takes every block ``quota // blocks`` times, and the
rest as a systematic selection from a seeded start. So what a document gives follows from where it
lies in the stream, and no block is ever a row.

Edges: a null or blank text has size 0 and gives nothing. A null source is a source of its own, the
last. Repeated rows are documents of their own. A null ``doc_id`` is allowed. Empty tables give
empty results. Other columns of the input are ignored.

Rows of the same id, source and size lie side by side in the stream, as one row with their number, so
a shard has no more rows than words, and of one id (or none) no more than sizes. Rows of size 0 lie in
no stream.
"""

from heapq import heapify, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from metertide.workspace import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Copies of one row that a task writes at a time.
COPIES_AT_ONCE = 1 << 16


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients ``weight / (2 * seats so far + 1)``; ties to the earlier party.

    No party gets more than its cap. At a divisor slightly above the fair one no party's rounded
    share is too large, and at most one seat a party is left to be given singly.
    """
    weights, caps = np.asarray(weights, dtype=float), np.asarray(caps, dtype=np.int64)
    given = np.zeros(len(weights), dtype=np.int64)
    seats = min(int(seats), int(caps[weights > 0].sum()))
    open_ = (weights > 0) & (caps > 0)
    while seats > given.sum() and open_.any():
        free, left = np.flatnonzero(open_), seats - int(given[~open_].sum())
        if 2 * left > len(free):
            divisor = weights[free].sum() / (2 * left - len(free)) * (1 + 1e-9)
            given[free] = np.floor((weights[free] / divisor + 1) / 2).astype(np.int64)
            over = free[given[free] >= caps[free]]
            if len(over):  # these are full whatever the others get; the rest is dealt anew
                given[over] = caps[over]
                open_[over] = False
                continue
        queue = [(-weights[i] / (2 * given[i] + 1), i) for i in free.tolist()]
        heapify(queue)
        for _ in range(seats - int(given.sum())):
            i = queue[0][1]
            given[i] += 1
            full = given[i] >= caps[i]
            heapreplace(queue, (1.0 if full else -weights[i] / (2 * given[i] + 1), i))
        break
    return given


def _quotas(key: str, share: str):
    def quotas(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, ignore_index=True, na_position="last")
        seats = int(rows["seats"].iloc[0])
        return rows.assign(quota=sainte_lague(rows[share], seats, rows["cap"]))

    return quotas


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _number(digest: Column, start: int) -> Column:
    """32 bits of a hexadecimal digest as a number."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2
) -> DataFrame:
    """Per source its place, ``source_size`` and ``target`` in words.

    ``sizes`` holds ``source`` and ``size``. In order of capacity by weight, the level that a source
    would get if all before it were full rises while they are and falls afterwards, so its maximum
    is the level at which shares and caps add up. One row per source goes through each window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn(
            "weight",
            F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")),
        )
    )
    cap = F.col("source_size") * epochs
    filled = Window.orderBy(cap.cast("double") / F.col("weight"), "place")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rest = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share))
        - F.coalesce(F.sum(cap).over(before), F.lit(0))
    ) / F.sum("weight").over(rest)
    return (
        sources.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(cap.cast("double"), F.col("level") * F.col("weight")))
        .select("source", "place", "source_size", "target")
    )


def mix_to_targets(
    documents: DataFrame,
    weights=WEIGHTS,
    share: float = 1.5,
    epochs: int = 2,
    block_words: int = 32,
    shard_words: int = 1 << 20,
    seed: str = "mix-1",
) -> DataFrame:
    """Per document its ``size``, its source's ``source_size`` and ``target``, and what is ``taken``.

    ``copies`` says how often the whole text is taken, ``first`` its place in its shard's stream,
    and ``blocks``, ``extra``, ``start`` which further blocks are (see ``is_extra``). All are 0 for
    size 0.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = materialize(
        documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes"
    )
    sources = materialize(
        source_targets(sizes, weights, share, epochs).withColumn(
            "shards", F.ceil(F.greatest("source_size", F.lit(1)) / shard_words)
        ),
        "sources",
    )
    # Few rows by their nature, but not by proof: the size decides how they are joined.
    of_source = F.col("source").eqNullSafe(F.col("of"))
    named = sources.withColumnRenamed("source", "of")
    placed = (
        sizes.filter("size > 0")
        .groupBy("doc_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("rows"))
        .join(named, of_source)
        .withColumn("digest", digest)
        .withColumn("shard", _number(F.col("digest"), 1) % F.col("shards"))
        .withColumn("words", F.col("rows") * F.col("size"))
    )
    shard_sizes = materialize(
        placed.groupBy("place", "shard").agg(F.sum("words").alias("shard_size")), "shards"
    ).withColumn("blocks", F.ceil(F.col("shard_size") / block_words))
    wanted = sources.groupBy().agg(F.sum("target").alias("words"))
    words = wanted.first()["words"] or 0.0
    capacity = shard_sizes.groupBy("place").agg((F.sum("blocks") * epochs).alias("cap"))
    per_source = (
        sources.join(capacity, "place")
        .select("place", "target", "cap", F.lit(int(words / block_words + 0.5)).alias("seats"))
        .groupBy()
        .applyInPandas(
            _quotas("place", "target"),
            "place int, target double, cap long, seats long, quota long",
        )
        .select("place", F.col("quota").alias("seats"))
    )
    per_shard = materialize(
        shard_sizes.join(per_source, "place")
        .withColumn("cap", F.col("blocks") * epochs)
        .select("place", "shard", "shard_size", "blocks", "cap", "seats")
        .groupBy("place")
        .applyInPandas(
            _quotas("shard", "shard_size"),
            "place int, shard long, shard_size long, blocks long, cap long, seats long, quota long",
        ),
        "quotas",
    )
    stream = Window.partitionBy("place", "shard").orderBy("digest", "doc_id", "size")
    in_stream = placed.withColumn(
        "first", F.sum("words").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    )
    blocks, name = F.greatest("blocks", F.lit(1)), F.concat_ws("|", F.lit(seed), "place", "shard")
    places = (
        in_stream.join(per_shard.drop("cap", "seats"), ["place", "shard"])
        .withColumn("copies", F.expr("quota div greatest(blocks, 1)"))
        .withColumn("extra", F.col("quota") % blocks)
        .withColumn("start", _number(F.md5(name), 1) % blocks)
    )
    of_document = ("doc_id", "source", "size", "source_size", "target")
    of_place = ("taken", "copies", "first", "blocks", "extra", "start")
    taken = F.col("copies") * F.col("size") + F.expr(_extra_words(block_words))
    with_words = _each_row(
        materialize(places.select(*of_document, "rows", *of_place[1:]), "places")
    ).withColumn("taken", taken)
    nothing = [F.lit(0).cast("long").alias(name) for name in of_place]
    without = sizes.filter("size = 0").join(named, of_source).select(*of_document, *nothing)
    return with_words.select(*of_document, *of_place).unionByName(without)


def _each_row(places: DataFrame) -> DataFrame:
    """Each of ``rows`` equal rows with its own ``first``; very many are dealt out in parts."""

    def rows(found: DataFrame, begin: Column, end: Column) -> DataFrame:
        return found.withColumn("_row", F.explode(F.sequence(begin, end))).withColumn(
            "first", F.col("first") + F.col("_row") * F.col("size")
        )

    last, step = F.col("rows") - 1, F.lit(COPIES_AT_ONCE).cast("long")
    few = rows(places.filter(last < step), F.lit(0).cast("long"), last).drop("_row", "rows")
    parts = places.filter(last >= step).withColumn(
        "_begin", F.explode(F.sequence(F.lit(0).cast("long"), last, step))
    )
    many = rows(
        parts.repartition("doc_id", "source", "size", "_begin"),
        F.col("_begin"),
        F.least(F.col("_begin") + step - 1, last),
    ).drop("_row", "_begin", "rows")
    return few.unionByName(many)


def _extra_words(block_words: int) -> str:
    """Words of the further blocks between a document's first and last place in its stream.

    Of the first ``i`` blocks ``(i * extra + start) div blocks`` are taken. All hold ``block_words``
    words but the last of a shard, which counts for what it holds.
    """
    taken = "(({i}) * extra + start) div greatest(blocks, 1)"
    inside = f"({{x}}) div {block_words}"

    def before(x: str) -> str:
        i = inside.format(x=x)
        whole = f"({taken.format(i=i)}) * {block_words}"
        step = f"(({taken.format(i=f'{i} + 1')}) - ({taken.format(i=i)}))"
        return f"({whole} + {step} * (({x}) - ({i}) * {block_words}))"

    return f"{before('first + size')} - {before('first')}"


def is_extra(place: Column, block_words: int = 32, of=F.col) -> Column:
    """Whether the word at ``place`` of its shard's stream lies in a further block."""
    block, blocks = F.floor(place / block_words), F.greatest(of("blocks"), F.lit(1))
    taken = [F.floor(((block + i) * of("extra") + of("start")) / blocks) for i in (0, 1)]
    return taken[1] > taken[0]


def mixed_documents(documents: DataFrame, block_words: int = 32, **options) -> DataFrame:
    """The mix as rows of ``documents``: each whole copy, then the words of further blocks.

    A further part holds its words joined by single spaces; ``n_chars`` follows the text where the
    input has that column. Rows that share a ``doc_id``, source and size share the first of their places,
    so reruns agree. Columns may have any names.
    """
    # Names that no column has, for what the mix says of a row and for the number of a copy.
    mix_name, part_name = "_mix", "_part"
    while {mix_name, part_name} & {c.lower() for c in documents.columns}:
        mix_name, part_name = "_" + mix_name, "_" + part_name

    def of(name: str) -> Column:
        return F.col(f"{mix_name}.{name}")

    numbers = ("first", "taken", "copies", "blocks", "extra", "start")
    mix = mix_to_targets(documents, block_words=block_words, **options).filter("taken > 0")
    parts = (
        mix.groupBy("doc_id", "source", "size")
        .agg(F.min(F.struct(*numbers)).alias("place"))
        .select(F.struct("doc_id", "source", "size", "place.*").alias(mix_name))
    )
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    chosen = F.array_join(
        F.filter(words, lambda _, i: is_extra(of("first") + i, block_words, of)), " "
    )
    joined = documents.join(
        parts,
        F.col("doc_id").eqNullSafe(of("doc_id"))
        & F.col("source").eqNullSafe(of("source"))
        & (word_count(F.col("text")) == of("size")),
    )
    whole, part = F.col(part_name) < of("copies"), of("taken") > of("copies") * of("size")
    rows = joined.withColumn(
        part_name, F.explode(F.sequence(F.lit(0), of("copies").cast("int")))
    ).filter(whole | part)
    rows = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(chosen))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.length("text").cast(kind))
    return rows.select(*[F.col(f"`{c}`") for c in documents.columns])
