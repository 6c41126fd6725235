"""Token ids of texts by a public tokenizer, word by word.

Most words are plain letters, perhaps with punctuation after them. Such a word's ids are those of its
letters and those of the punctuation, and letters go to the vocabulary's model directly. All other
words go through the whole tokenizer. Letters and words that were seen lately are looked up, until
``forget`` is called at a task's end, as the workers live on for tasks of other kinds.
"""

import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from metertide.llm.batches import Words, words_of

#: Words whose ids are kept from slice to slice, at about 150 bytes each; beyond it they are forgotten
#: and found again. Plain words are kept by their letters alone, in lower case, whatever marks follow.
KEPT_WORDS = 300_000
#: Ids are kept as unsigned 32-bit numbers in a row.
ID = "I"
ID_BYTES = array(ID).itemsize
END = r"[.!?][\"')\]]*$"
#: Letters that lower-casing and normalising treat one by one, then marks that don't join letters.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
    return tokenizer


@cache
def _known(path: str) -> dict[str, bytes]:
    return {}


def forget(path: str) -> None:
    """Keep no word's ids any longer."""
    _known(path).clear()


@cache
def _byte_names() -> dict[int, str]:
    """How byte-level vocabularies write bytes: visible ones as they are, the others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@cache
def splits_plainly(path: str) -> bool:
    """Whether the short way gives what the tokenizer gives, on words of every letter and mark."""
    tokenizer = _tokenizer(path)
    letters = "".join(chr(c) for c in range(65, 256) if PLAIN.fullmatch(chr(c)))
    words = [f"{a}{b}{m}" for a in letters for b in "eÉ" for m in ("", ".", "!!", ",\"", "|")]
    found = tokenizer.encode_batch(words, add_special_tokens=False)
    same = all(_plain_ids(path, w) == _packed(x.ids) for w, x in zip(words, found, strict=True))
    forget(path)  # if it does not, these ids are not the words'
    return same


def _packed(ids: list[int]) -> bytes:
    return array(ID, ids).tobytes()


def _model_ids(path: str, letters: str) -> bytes:
    if not letters.isascii():
        letters = letters.encode().decode("latin-1").translate(_byte_names())
    return _packed([token.id for token in _tokenizer(path).model.tokenize(letters)])


def _plain_ids(path: str, word: str) -> bytes | None:
    """Ids of a plain word, None of any other."""
    match = PLAIN.fullmatch(word)
    if match is None:
        return None
    known = _known(path)
    letters, marks = match[1].lower(), match[2]
    ids = known.get(letters)
    if ids is None:
        ids = known[letters] = _model_ids(path, letters)
    if not marks:
        return ids
    after = known.get(marks)
    if after is None:
        found = _tokenizer(path).encode(marks, add_special_tokens=False).ids
        after = known[marks] = _packed(found)
    return ids + after


def ids_of_words(path: str, words: pa.Array) -> list[bytes]:
    """Ids of each distinct word. No token crosses white space in a vocabulary that drops it."""
    known, words = _known(path), words.to_pylist()
    plainly, result, others = splits_plainly(path), [], []
    if len(known) > KEPT_WORDS:
        known.clear()
    for place, word in enumerate(words):
        ids = _plain_ids(path, word) if plainly else None
        if ids is None:
            ids = known.get(word)
            if ids is None:
                others.append(place)
        result.append(ids)
    if others:
        texts = [words[i] for i in others]
        found = _tokenizer(path).encode_batch(texts, add_special_tokens=False)
        for place, text, x in zip(others, texts, found, strict=True):
            result[place] = known[text] = _packed(x.ids)
    return result


def token_ids(path: str, texts: pa.Array, last: int):
    """Ids of all texts in a row, each followed by ``last``; where each text ends; and the places
    after a word that ends a sentence."""
    words: Words = words_of(texts)
    # The end of a text is one more word, after its last one.
    lists = [*ids_of_words(path, words.distinct), _packed([last])]
    index = np.insert(words.index, words.starts[1:], len(lists) - 1)
    lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)) // ID_BYTES
    closing = pc.match_substring_regex(words.distinct, END).to_numpy(zero_copy_only=False)
    closing = np.append(closing, False)
    words = None
    ids = np.frombuffer(b"".join(map(lists.__getitem__, memoryview(index))), dtype=np.uint32)
    after = np.cumsum(lengths[index])
    return ids, after[index == len(lists) - 1], after[closing[index]]
