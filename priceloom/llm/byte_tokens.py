"""Ids of a byte-level BPE tokenizer for whole Arrow batches of texts.

The tokenizer parts a text before every white space that follows anything else, and
a single blank belongs to the token after it. A text whose white space is single
blanks and line feeds is therefore the join of its words, each with the blank or line feed
before it. Words are told apart by Arrow, every distinct word is encoded once, and
ids are gathered by numpy. Other texts are encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from priceloom.llm.tokens import remembered

#: White space as the tokenizer's pattern sees it (a fixed value of Unicode).
SPACES = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A word with the line feed before it, if any, and no other white space.
PLAIN = f"^\n?[^{SPACES}]+$"
# A worker remembers this many words that it met last, and as many before them.
MEMORY_WORDS = 400_000
# Texts of odd spacing are encoded in sections of about this many characters.
SECTION = 1 << 20
_EDGE = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])")


class _Words:
    """Ids of words one after another, and the place of each word among them."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.lengths = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def add(self, words: list[str], ids: list[np.ndarray], lengths: list[np.ndarray]) -> None:
        self.number.update(zip(words, range(len(self.lengths), len(self.lengths) + len(words))))
        self.ids = np.concatenate([self.ids, *ids])
        self.lengths = np.concatenate([self.lengths, *lengths])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with these numbers one after another, and how many each has."""
        counts = self.lengths[numbers]
        shift = self.starts[numbers] - np.cumsum(counts) + counts
        return self.ids[np.repeat(shift, counts) + np.arange(counts.sum())], counts


class Encoder:
    """A tokenizer and the words that it encoded last."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.now, self.before = _Words(), _Words()

    def turn(self) -> None:
        """The words met since the last turn become the former ones."""
        if len(self.now.number) > MEMORY_WORDS:
            self.now, self.before = _Words(), self.now

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of ``words`` in ``now``; unknown ones are encoded."""
        missing = list(dict.fromkeys(w for w in words if w not in self.now.number))
        known = [w for w in missing if w in self.before.number]
        if known:
            ids, counts = self.before.get(np.fromiter(map(self.before.number.__getitem__, known), np.int64, len(known)))
            self.now.add(known, [ids], [counts])
            missing = [w for w in missing if w not in self.before.number]
        ids, counts = [], []
        for at in range(0, len(missing), 4096):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(missing[at:at + 4096], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), np.uint32, int(counts[-1].sum())))
        if missing:
            self.now.add(missing, ids, counts)
        return np.fromiter(map(self.now.number.__getitem__, words), np.int64, len(words))


def whole(text: str, tokenizer) -> np.ndarray:
    """Ids of one text, encoded in sections that end where the tokenizer parts any text."""
    out, start = [], 0
    while start < len(text):
        edge = _EDGE.search(text, start + SECTION) if len(text) - start > SECTION else None
        end = edge.start() if edge else len(text)
        out.append(np.asarray(tokenizer.encode(text[start:end], add_special_tokens=False).ids, dtype=np.uint32))
        start = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all ``texts`` (no nulls) one after another, and the number of ids of each."""
    encoder = remembered(f"byte ids {path}", lambda: Encoder(path))
    encoder.turn()
    if not len(texts):
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    sizes = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = parts.flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False)
    begins = np.cumsum(sizes) - sizes
    plain = pc.match_substring_regex(words.dictionary, PLAIN).to_numpy(zero_copy_only=False)
    odd = ~np.logical_and.reduceat(plain[codes], begins)
    regular = np.nonzero(~odd)[0]
    # every word but the first of a text, which has no blank before it, and those after a line feed
    heads = words.dictionary.take(pa.array(codes[begins[regular]])).to_pylist()
    spelled = pc.if_else(pc.starts_with(words.dictionary, "\n"), words.dictionary, pc.binary_join_element_wise(" ", words.dictionary, ""))
    number = np.zeros(len(spelled), dtype=np.int64)
    if odd.any():
        used = np.zeros(len(spelled), dtype=bool)
        used[codes[np.repeat(~odd, sizes)]] = True
        chosen = np.nonzero(used)[0]
        number[chosen] = encoder.numbers(spelled.take(pa.array(chosen)).to_pylist())
        codes = codes[np.repeat(~odd, sizes)]
    else:
        number[:] = encoder.numbers(spelled.to_pylist())
    at = number[codes]
    begins = np.cumsum(sizes[regular]) - sizes[regular]
    at[begins] = encoder.numbers(heads)
    ids, counts = encoder.now.get(at)
    per_text = np.zeros(len(texts), dtype=np.int64)
    per_text[regular] = np.add.reduceat(counts, begins) if len(regular) else 0
    if len(regular) == len(texts):
        return ids, per_text
    ends, pieces = np.cumsum(per_text), []
    for i in range(len(texts)):
        piece = whole(texts[i].as_py(), encoder.tokenizer) if odd[i] else ids[ends[i] - per_text[i]:ends[i]]
        per_text[i] = len(piece)
        pieces.append(piece)
    return np.concatenate(pieces), per_text
