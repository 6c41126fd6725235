"""I-Match fingerprints, in DataFrame functions only.

A text's terms are its distinct runs of letters and digits in lower case. Those within a band of
inverse document frequency are kept: frequent terms say nothing about a text, and terms that no
other document has are mostly slips. The kept terms are dealt to ``PARTS`` random parts of the lexicon,
and each part's terms, sorted, are hashed to one signature. A changed term changes one signature.

So that a signature stands for one or two terms whatever the text's length, only terms of a random
lexicon of density ``2 ** -level`` count, and the level is the whole part of the logarithm of the
number of kept terms by ``PARTS``. The fingerprint holds the signatures of that level and the next
sparser one, so texts of somewhat different length still have a level in common. Likeness is the
share of equal signatures at the common levels, among those that are empty in neither or one.

Document frequencies are counted over all documents, by hash of the term, in ``BUCKETS`` buckets; the
buckets within the band are a bit map of that fixed size, whatever the corpus, which is part of the
plan. Terms that share a bucket share its count.

Edges: a null text counts as empty. A text without a kept term uses all its terms; one without terms
has the fingerprint of none. Equal texts have equal fingerprints, and likeness 1.
"""

from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame, Window, functions as F

from metertide.operators.ordering import BLOCK, POSITION, in_blocks
from metertide.workspace import materialize

BUCKETS = 1 << 20
PARTS = 32
SIGNATURE = 4  # hexadecimal digits
#: Terms in more than one of ten documents, and in fewer than two, are left out.
MOST_SHARE, LEAST_DOCUMENTS = 0.1, 2
NOT_A_TERM = r"[^\p{L}\p{N}]+"
#: Bits of a term's hash: bucket 0-19, part 40-44, level from 45.
_PART_BIT, _LEVEL_BIT = 40, 45
_NOTHING = "0" * SIGNATURE
#: Copies of one row that a task writes at a time.
COPIES_AT_ONCE = 1 << 16


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def term_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), NOT_A_TERM), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _bucket(term: Column) -> Column:
    return term.bitwiseAND(F.lit(BUCKETS - 1))


def document_frequencies(documents: DataFrame) -> DataFrame:
    """``bucket`` and ``n``, the documents with a term in it."""
    buckets = F.array_distinct(F.transform(term_hashes(F.col("text")), _bucket))
    return documents.select(F.explode(buckets).alias("bucket")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n")
    )


def lexicon(
    documents: DataFrame, most_share: float = MOST_SHARE, least: int = LEAST_DOCUMENTS
) -> Column:
    """The buckets within the band as a constant array of 64-bit words.

    The band is from ``log(1 / most_share)`` to ``log(documents / least)``.
    """
    rows = max(1, documents.count())
    lowest, highest = log(1 / most_share), log(max(1.0, rows / least))
    weight = F.log(F.lit(float(rows)) / F.col("n"))
    bits = (
        document_frequencies(documents)
        .filter((weight >= lowest - 1e-9) & (weight <= highest + 1e-9))
        .groupBy(F.shiftright("bucket", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bucket & 63 as int))")).alias("bits"))
        .toPandas()
    )
    words = [0] * (BUCKETS // 64)
    for word, value in zip(bits["word"].tolist(), bits["bits"].tolist(), strict=True):
        words[word] = value
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def _signatures(terms: Column, level: Column) -> Column:
    """Signatures of all parts at a level, in a row; ``terms`` are sorted."""

    def counts(term: Column) -> Column:
        above = F.call_function("shiftrightunsigned", term, F.lit(_LEVEL_BIT))
        return F.pmod(above, F.call_function("shiftleft", F.lit(1).cast("long"), level)) == 0

    def signature(kept: Column, part: Column) -> Column:
        own = F.filter(
            kept,
            lambda t: F.call_function("shiftrightunsigned", t, F.lit(_PART_BIT)).bitwiseAND(
                F.lit(PARTS - 1)
            )
            == part,
        )
        return let(
            own,
            lambda x: F.when(F.size(x) == 0, F.lit(_NOTHING)).otherwise(
                F.substring(F.lpad(F.hex(F.xxhash64(x)), 16, "0"), 1, SIGNATURE)
            ),
        )

    return let(
        F.filter(terms, counts),
        lambda kept: F.array_join(
            F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda part: signature(kept, part)), ""
        ),
    )


def fingerprint(text: Column, band: Column) -> Column:
    """Two digits of level, then the signatures of that level and of the next."""

    def in_band(term: Column) -> Column:
        word = F.get(band, F.shiftright(_bucket(term), 6).cast("int"))
        return F.getbit(word, term.bitwiseAND(F.lit(63)).cast("int")) == 1

    def of_terms(terms: Column) -> Column:
        level = F.floor(F.log2(F.greatest(F.size(terms) / PARTS, F.lit(1.0)))).cast("int")
        return let(
            level,
            lambda x: F.lower(
                F.concat(
                    F.lpad(x.cast("string"), 2, "0"),
                    _signatures(terms, x),
                    _signatures(terms, x + 1),
                )
            ),
        )

    def of_all(terms: Column) -> Column:
        kept = F.filter(terms, in_band)
        return let(
            let(kept, lambda k: F.array_sort(F.when(F.size(k) > 0, k).otherwise(terms))), of_terms
        )

    return let(term_hashes(F.coalesce(text, F.lit(""))), of_all)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures at the levels that two fingerprints have in common."""
    width = PARTS * SIGNATURE

    def level(x: Column) -> Column:
        return F.substring(x, 1, 2).cast("int")

    def compared(x: Column, x_from: int, y: Column, y_from: int, length: int) -> Column:
        def part(z: Column, begin: int, i: Column) -> Column:
            return z.substr(i * SIGNATURE + begin, F.lit(SIGNATURE))

        places = F.sequence(F.lit(0), F.lit(length // SIGNATURE - 1))
        pairs = F.transform(
            places, lambda i: F.struct(part(x, x_from, i).alias("x"), part(y, y_from, i).alias("y"))
        )
        some = F.filter(pairs, lambda p: (p["x"] != _NOTHING) | (p["y"] != _NOTHING))
        return let(
            some,
            lambda s: F.when(
                F.size(s) > 0,
                F.size(F.filter(s, lambda p: p["x"] == p["y"])) / F.size(s),
            ).otherwise(F.lit(0.0)),
        )

    first, second = 3, 3 + width
    return (
        F.when(a == b, F.lit(1.0))
        .when(level(a) == level(b), compared(a, first, b, first, 2 * width))
        .when(level(a) + 1 == level(b), compared(a, second, b, first, width))
        .when(level(a) == level(b) + 1, compared(a, first, b, second, width))
        .otherwise(F.lit(0.0))
    )


def fingerprints(documents: DataFrame, **band) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every document."""
    words = lexicon(documents.select("text"), **band)
    return documents.select("doc_id", fingerprint(F.col("text"), words).alias("fingerprint"))


def next_documents(
    documents: DataFrame, key: str = "doc_id", order: Sequence[Column] | None = None
) -> DataFrame:
    """``documents`` and ``next_id``, the ``key`` of the row that follows, or the first one after the last.

    Without ``order`` rows come by descending ``key``, which tells rows apart. They are sorted in
    blocks; the first of each block is joined to the block before. One row per block goes through one
    task.
    """
    blocks = in_blocks(documents, order or [F.desc(key)], "descending-ids")
    inside = Window.partitionBy(BLOCK).orderBy(POSITION)
    firsts = blocks.filter(F.col(POSITION) == 0).select(
        F.col(BLOCK).alias("_of"), F.col(key).alias("_first")
    )
    by_block = Window.orderBy("_of")
    whole = by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select(
        "_of",
        F.coalesce(F.lead("_first").over(by_block), F.first("_first").over(whole)).alias("_after"),
    )
    return (
        blocks.withColumn("_next", F.lead(key).over(inside))
        .join(after, F.col(BLOCK) == F.col("_of"))
        .select(*documents.columns, F.coalesce("_next", "_after").alias("next_id"))
    )


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Every row as often as ``times`` says, which is dropped; many copies are dealt out in parts."""
    columns = [c for c in rows.columns if c != times]
    part = F.lit(COPIES_AT_ONCE).cast("bigint")
    one = F.lit(1).cast("bigint")
    parts = rows.withColumn("_begin", F.explode(F.sequence(one, times, part)))
    last = F.least(F.col("_begin") + part - 1, F.col(times))
    dealt = parts.repartition("_key", "_begin").withColumn(
        "_copy", F.explode(F.sequence("_begin", last))
    )
    return dealt.select(columns)


def edited_fingerprints(documents: DataFrame, **band) -> DataFrame:
    """Fingerprints of every document and of its edit, and how like it the edit and the next one are.

    The edit replaces the last third of a text's characters by as many of the next document's first, in
    descending ``doc_id`` (after the last: the first). Every row is a document: rows with a null ``doc_id``
    come last, rows that share an id by the SHA-256 of their texts, and the next of a wholly equal row
    is its copy, but for the last of them.

    Equal rows are worked on once and copied at the end. Texts are shuffled once, by a key made of id
    and SHA-256, for both joins; of the next document only its beginning moves on.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = documents.select("doc_id", text.alias("text"))
    words = lexicon(texts.select("text"), **band)
    # The id, of which a null one adds nothing, and then always 16 bytes of the checksum.
    written = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    key = F.concat(written, F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    keyed = texts.withColumn("_key", key)
    # Only the text, so that both joins read the same shuffle; the id comes with the pairs.
    unique = keyed.groupBy("_key").agg(F.min("text").alias("text"))
    ids = (
        keyed.select("_key", "doc_id", F.length("text").alias("n_chars"))
        .groupBy("_key")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_chars").alias("n_chars"),
            F.count(F.lit(1)).alias("_copies"),
        )
    )
    pairs = materialize(
        next_documents(ids, "_key", [F.desc_nulls_last("doc_id"), F.col("_key")]), "next-documents"
    )
    most = F.floor(F.col("n_chars") / 3).cast("int").alias("_most")
    # What follows the last of equal rows, and what follows each of the others: its copy.
    wanted = pairs.select(
        F.col("next_id").alias("_from"), F.col("_key").alias("_to"), "doc_id", most,
        F.lit(0).alias("_before"),
    ).unionByName(
        pairs.filter("_copies > 1").select(
            F.col("_key").alias("_from"), F.col("_key").alias("_to"), "doc_id", most,
            (F.col("_copies") - 1).alias("_before"),
        )
    )
    heads = unique.join(wanted, F.col("_key") == F.col("_from")).select(
        "_to", "_from", "_before", "doc_id", F.col("text").substr(F.lit(1), F.col("_most")).alias("_head")
    )
    replaced = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(
        F.col("text").substr(F.lit(1), F.length("text") - replaced),
        F.col("_head").substr(F.lit(1), replaced),
    )
    own = (
        unique.join(heads, F.col("_key") == F.col("_to"))
        .select("_key", "_from", "_before", "doc_id", "text", edited.alias("edited"))
        .select(
            "_key",
            "_from",
            "_before",
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.unhex(F.sha2("edited", 256)).alias("edited_sha256"),
            F.unhex(fingerprint(F.col("text"), words)).alias("fingerprint"),
            F.unhex(fingerprint(F.col("edited"), words)).alias("edited_fingerprint"),
        )
    )
    own = materialize(own, "fingerprints")
    last = own.filter("_before = 0")
    following = last.select(F.col("_key").alias("_id"), F.col("fingerprint").alias("_following"))
    with_next = last.join(following, F.col("_from") == F.col("_id"))

    def digits(name: str) -> Column:
        """What is kept and shuffled as bytes."""
        return F.lower(F.hex(name)).alias(name)

    def result(rows: DataFrame, following: str) -> DataFrame:
        return rows.select(
            "doc_id",
            "n_chars",
            *map(digits, ("edited_sha256", "fingerprint", "edited_fingerprint")),
            digits(following).alias("_following"),
        ).select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            "fingerprint",
            "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("_following")).alias("near_next"),
        )

    copies = repeated(own.filter("_before > 0"), "_before")
    return result(with_next, "_following").unionByName(result(copies, "fingerprint"))
