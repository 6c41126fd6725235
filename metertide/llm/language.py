"""Language ID by mixture inference.

Every word of a text is taken to come from one of the learned languages, which are mixed in unknown
proportions. Letter trigrams give each word's likelihood in each language; expectation-maximisation
finds the proportions; the set of languages is the one with the best likelihood less a penalty for
each language beyond the first, among the sets of the first 1, 2, ... languages by proportion.

Trigrams are those of the UTF-8 bytes of lower-cased letters, words padded with a blank, counted in
``BUCKETS`` hash buckets per language over all labelled documents. The model has ``BUCKETS`` rows a
language, whatever the corpus, and is what goes to the driver.

Edges: a text that is null, empty or has no letter is ``und`` with score 0, and so is every text if
nothing was learned. Null labels, texts and ids teach nothing. Ties go to the language first by code
point. Repeated rows are documents of their own. Other columns of the input are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from metertide.llm.batches import Words, concatenated, slices, words_of

BUCKETS = 1 << 16
SMOOTHING = 0.5
#: No word speaks against a language by more than this, so one typo does not decide a text.
MOST_AGAINST = 30.0
ROUNDS = 10
PENALTY = 1.0
UNKNOWN = "und"


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text has this remainder; false for a null key."""
    return F.coalesce(
        F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False)
    )


def trigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of the trigrams of each word, the word they belong to, and which have letters."""
    letters = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)
    clean = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}]+", " ")
    data, starts = concatenated(pc.binary_join_element_wise(" ", clean, " ", ""))
    lengths = np.diff(starts) - 2
    lengths[~letters] = 0
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(owner)) + np.repeat(starts[:-1] - (np.cumsum(lengths) - lengths), lengths)
    code = data[place].astype(np.uint32) << 16
    code |= data[place + 1].astype(np.uint32) << 8
    code |= data[place + 2]
    return (code * np.uint32(2654435761)) >> np.uint32(16), owner, letters


def count_trigrams(labelled: DataFrame) -> DataFrame:
    """``lang``, ``bucket`` and how often it occurs, from ``text`` and ``lang``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in slices(batches):
            words = words_of(part.column("text"))
            buckets, owner, _ = trigrams(words.distinct)
            langs = part.column("lang").dictionary_encode()
            of_word = np.repeat(langs.indices.to_numpy(zero_copy_only=False), words.counts)
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                times = np.bincount(words.index[of_word == code], minlength=len(words.distinct))
                found = np.bincount(buckets, weights=times[owner], minlength=BUCKETS)
                totals[lang] = totals.get(lang, 0) + found.astype(np.int64)
        for lang, found in totals.items():
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang] * len(some), "bucket": some.astype(np.int32), "n": found[some]}
            )

    return (
        labelled.select("text", "lang")
        .filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )


def learn_languages(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names of the languages, and the log probability of every bucket in each."""
    counts = count_trigrams(labelled).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    for column, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        table[own["bucket"], column] += own["n"]
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _fit(likely, begins, counts, among):
    """Proportions among the allowed languages by expectation-maximisation, their log likelihood,
    and how much more any proportions could reach (a bound from the slope at the fit)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    share = (among / among.sum(axis=1, keepdims=True)).astype(np.float32)
    per_text = counts[:, None].astype(np.float32)
    for _ in range(ROUNDS):
        mixed = likely * share[owner]
        mixed /= mixed.sum(axis=1, keepdims=True)
        share = np.add.reduceat(mixed, begins, axis=0) / per_text
    total = (likely * share[owner]).sum(axis=1)
    slope = np.add.reduceat(likely / total[:, None], begins, axis=0)
    reach = np.maximum(0, np.where(among, slope, 0).max(axis=1) - counts)
    return share, np.add.reduceat(np.log(total), begins), reach


def infer_mixtures(words: Words, table: np.ndarray, penalty: float = PENALTY):
    """Per text the proportions of all languages, 0 outside the chosen set; zeros without a letter."""
    if not table.shape[1]:
        return np.zeros((len(words.counts), 0), dtype=np.float32)
    buckets, owner, letters = trigrams(words.distinct)
    logs = np.zeros((len(words.distinct), table.shape[1]), dtype=np.float32)
    some = np.flatnonzero(letters)
    if len(some):
        counts = np.bincount(owner, minlength=len(letters))[some]
        logs[some] = np.add.reduceat(table[buckets], np.cumsum(counts) - counts, axis=0)
    logs -= logs.max(axis=1, keepdims=True)
    np.maximum(logs, -MOST_AGAINST, out=logs)
    kept = letters[words.index]
    index = words.index[kept]
    ends = np.concatenate(([0], np.cumsum(kept)))[words.starts]
    known = np.flatnonzero(np.diff(ends))
    counts = np.diff(ends)[known]
    result = np.zeros((len(words.counts), table.shape[1]), dtype=np.float32)
    if not len(known):
        return result
    begins = ends[known]
    single = np.add.reduceat(logs[index], begins, axis=0)
    likely = np.exp(logs)[index]
    everything = np.ones(single.shape, dtype=bool)
    share, fitted, reach = _fit(likely, begins, counts, everything)
    cost = penalty * np.log(counts + 1.0)
    best = single.max(axis=1)
    chosen = np.zeros_like(share)
    chosen[np.arange(len(known)), single.argmax(axis=1)] = 1
    order = np.argsort(-share, axis=1, kind="stable")
    for size in range(2, table.shape[1] + 1):
        # Further sets are tried only where some proportions could still pay for another language.
        open_ = np.flatnonzero(best < fitted + reach - cost * (size - 1))
        if not len(open_):
            break
        among = np.zeros((len(open_), table.shape[1]), dtype=bool)
        np.put_along_axis(among, order[open_, :size], True, axis=1)
        rows = np.concatenate([np.arange(begins[i], begins[i] + counts[i]) for i in open_])
        own = np.cumsum(counts[open_]) - counts[open_]
        part, reached, _ = _fit(likely[rows], own, counts[open_], among)
        reached = reached - cost[open_] * (size - 1)
        better = reached > best[open_]
        chosen[open_[better]] = part[better]
        best[open_[better]] = reached[better]
    result[known] = chosen
    return result


def identify_languages(
    documents: DataFrame, langs: list[str], table: np.ndarray, penalty: float = PENALTY
) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (its proportion) and ``mixture`` (language to proportion)."""

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, UNKNOWN], dtype=object)
        for part in slices(batches):
            shares = infer_mixtures(words_of(part.column("text")), table, penalty)
            # The last column stands for no language and wins where all others are 0.
            best = np.hstack([shares, np.zeros((len(shares), 1), np.float32)]).argmax(axis=1)
            score = shares.max(axis=1) if langs else np.zeros(len(shares))
            best[score == 0] = len(langs)
            mixtures = [
                [(langs[k], float(row[k])) for k in np.flatnonzero(row)] for row in shares
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(names[best], pa.string()),
                    pa.array(np.clip(score, 0, 1).astype(np.float64)),
                    pa.array(mixtures, pa.map_(pa.string(), pa.float64())),
                ],
                ["doc_id", "lang_pred", "score", "mixture"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        identify, f"doc_id {kind}, lang_pred string, score double, mixture map<string,double>"
    )


def of_known_language(
    documents: DataFrame, langs: list[str], table: np.ndarray, penalty: float = PENALTY
) -> DataFrame:
    """The rows of ``documents`` whose text is not ``und``, with all their columns."""

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            shares = infer_mixtures(words_of(part.column("text")), table, penalty)
            yield part.filter(pa.array((shares > 0).any(axis=1)))

    return documents.mapInArrow(known, documents.schema)
