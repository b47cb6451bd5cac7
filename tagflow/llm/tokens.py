"""Exact BPE ids at column speed.

A tokenizer file of the ``tokenizers`` library fixes the ids. A whole column of texts is cut at spaces by Arrow, each
distinct piece is encoded once, and the ids are gathered back, which is several times cheaper than encoding text by
text because corpora repeat their words. This is exact:

* byte-level files (spaces kept): the pre-tokenizer's pattern always breaks before a space that follows a character
  other than white space, and within a piece it sees all it looks at. Texts where white space, a space and white
  space (or the end) follow one another are the exception; the library itself encodes them whole.
* files with an end-of-word suffix drop white space, so no token spans it.

Texts with an added token's string also go to the library. Pieces met for the first time are merged by ``tiktoken``
over the file's own vocabulary (for the suffix, a newline stands in: words can't hold one).

Cases: a null is an empty text and has no ids; no texts give no ids. Texts of any length are taken as they are; callers
bound a column's bytes. Repeated texts are encoded as often, their pieces once.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

# The split patterns of the two kinds of tokenizer file, and white space as they know it.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: Pieces with other letters than these (whose lower case is among them), an apostrophe or unusual white space are encoded one by one.
RARE = r"[^\x00-\x{17f}]|['\x00\x0b\x1c-\x1f\x{85}\x{a0}\x{130}]"

#: Rare pieces that a worker remembers; the memory is emptied when full.
REMEMBERED = 100_000


@cache
def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def to_bytes(token: str) -> bytes:
    return bytes(map(byte_of_char().__getitem__, token))


MARK_KIND, WHITE_KIND, SPACE_KIND, LETTER_KIND, NUMBER_KIND, OTHER_KIND = range(6)


@cache
def kinds() -> np.ndarray:
    """The kind of each plain character."""
    of = {"L": LETTER_KIND, "N": NUMBER_KIND}
    out = np.array([of.get(unicodedata.category(chr(c))[0], OTHER_KIND) for c in range(0x250)], np.uint8)
    out[[9, 10, 12, 13]], out[32], out[0] = WHITE_KIND, SPACE_KIND, MARK_KIND
    return out


class ColumnBPE:
    """One tokenizer file, ready to encode columns of texts."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = added_tokens(path)
        self.suffix = spec["model"].get("end_of_word_suffix")
        self.vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        # Words are merged in one call, each with a mark behind it that no word holds.
        self.mark = "\n" if self.suffix else "\0"
        m, ranks = self.mark.encode(), {}
        for t, i in self.vocab.items():
            own = to_bytes(t.removesuffix(self.suffix) if self.suffix and t.endswith(self.suffix) else t)
            if m not in own:
                ranks[own + m * bool(self.suffix and t.endswith(self.suffix))] = i
            elif own == m and t != self.suffix and not (self.suffix and t.endswith(self.suffix)):
                ranks[own] = i
        self.merger = tiktoken.Encoding("words", pat_str=f"[^{self.mark}]+{self.mark}", mergeable_ranks=ranks, special_tokens={})
        self.stops = np.zeros(self.size, bool)
        if self.suffix:
            self.stops[[i for t, i in self.vocab.items() if t.endswith(self.suffix)]] = True
        else:
            self.stops[ranks[m]] = True
            whole = {to_bytes(t): i for t, i in self.vocab.items()}
            self.exact = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=whole, special_tokens={})
        self.rare: dict[str, np.ndarray] = {}

    def by_library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, end to end, and how many each has."""
        twice = "" if self.suffix else r"|[\t\n\f\r ][\t\n\f\r ]"
        rare = np.asarray(pc.match_substring_regex(pieces, RARE + twice))
        plain = pc.if_else(pa.array(rare), "", pieces) if rare.any() else pieces
        if self.suffix:
            plain = pc.utf8_lower(plain)
        marked = self.mark.join(plain.to_pylist()) + self.mark
        chars = np.frombuffer(marked.encode("utf-32-le"), np.uint32)
        kind = kinds()[chars]
        if self.suffix:
            last = np.flatnonzero(chars == ord(self.mark))  # of each piece, and line breaks within pieces
            lines = np.asarray(pc.count_substring(plain, self.mark), np.int64)
            last = last[np.cumsum(lines + 1) - 1]
            white = (kind == WHITE_KIND) | (kind == SPACE_KIND) | (kind == MARK_KIND)
            chars = np.where(white, ord(self.mark), chars)
            starts = ~white & (np.concatenate([[True], white[:-1]]) | (kind != np.roll(kind, 1)) | (kind == NUMBER_KIND))
            cuts = np.flatnonzero(starts[1:] & ~white[:-1]) + 1
        else:
            last = np.flatnonzero(kind == MARK_KIND)
            before = np.roll(kind, 1)
            before[0] = MARK_KIND
            joined = (before == SPACE_KIND) & (kind != WHITE_KIND) & (kind != SPACE_KIND)
            starts = (kind != MARK_KIND) & (kind != before) & ~joined
            cuts = np.flatnonzero(starts & (before != MARK_KIND))
        count = np.diff(np.cumsum(starts)[last], prepend=0)
        marked = np.insert(chars, cuts, ord(self.mark)).tobytes().decode("utf-32-le")
        ids = self.merger.encode_to_numpy(marked, disallowed_special=())
        stop = self.stops[ids]
        ends = np.flatnonzero(stop) + 1
        if not self.suffix:
            ids, ends = ids[~stop], ends - np.arange(1, len(ends) + 1)
        sizes = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])])
        if rare.any():
            at = np.flatnonzero(rare)
            ids, sizes = spliced(ids, sizes, at, [self.rarely(s) for s in pieces.take(pa.array(at)).to_pylist()])
        return ids, sizes

    def rarely(self, piece: str) -> np.ndarray:
        if (ids := self.rare.get(piece)) is None:
            if len(self.rare) >= REMEMBERED:
                self.rare.clear()
            ids = self.by_library(piece) if self.suffix else self.exact.encode_to_numpy(piece, disallowed_special=())
            self.rare[piece] = ids
        return ids

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more entry than texts). Nulls are empty texts."""
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        texts = pc.fill_null(texts, "")
        odd = np.zeros(len(texts), bool)
        for string in self.added:
            odd |= np.asarray(pc.match_substring(texts, string))
        if not self.suffix:
            odd |= np.asarray(pc.match_substring_regex(texts, f"[{WHITE}\x1c-\x1f] (?:[{WHITE}\x1c-\x1f]|\\z)"))
        odd_at = np.flatnonzero(odd)
        plain = pc.if_else(pa.array(odd), "", texts) if len(odd_at) else texts
        parts = pc.split_pattern(plain, " ")
        begins = np.asarray(parts.offsets, dtype=np.int64)
        begins = begins - begins[0]
        coded = parts.flatten().dictionary_encode()
        code, found = np.asarray(coded.indices), coded.dictionary
        if self.suffix:
            stock, sizes = self.pieces(found)
        else:  # the first piece of a text has no space before it
            code, first = code.astype(np.int64), code[begins[:-1]]
            bare = np.unique(first)
            code[begins[:-1]] = len(found) + np.searchsorted(bare, first)
            stock, sizes = self.pieces(pa.concat_arrays([pc.binary_join_element_wise("", found, " "), found.take(pa.array(bare))]))
        ids, ends = gather(stock, np.cumsum(sizes) - sizes, sizes, code)
        sizes = np.diff(np.concatenate([[0], ends])[begins])
        if len(odd_at):
            ids, sizes = spliced(ids, sizes, odd_at, [self.by_library(t) for t in texts.take(pa.array(odd_at)).to_pylist()])
        return ids, np.concatenate([[0], np.cumsum(sizes)])



def gather(stock: np.ndarray, begins: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``stock`` that ``code`` names, end to end, and the end of each."""
    n = sizes[code]
    ends = np.cumsum(n)
    at = np.repeat(begins[code] - (ends - n), n)
    at += np.arange(len(at))
    return stock[at], ends


def spliced(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray, own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with those of ``own`` at the (empty) places ``at``."""
    ends, sizes, out, last = np.cumsum(sizes), sizes.copy(), [], 0
    for i, ids_i in zip(at.tolist(), own, strict=True):
        out += [ids[last : ends[i]], ids_i]
        last, sizes[i] = ends[i], len(ids_i)
    return np.concatenate([*out, ids[last:]]), sizes


@cache
def added_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


@cache
def decoder(path: str) -> pa.Array:
    """The bytes of each id of a byte-level file."""
    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    added = added_tokens(path)
    rows = [b""] * (1 + max([*vocab.values(), *added.values()]))
    for t, i in vocab.items():
        if t not in added:
            rows[i] = to_bytes(t)
    for t, i in added.items():
        rows[i] = t.encode()
    return pa.array(rows, pa.large_binary())


@cache
def token_sizes(path: str) -> np.ndarray:
    """The number of bytes of each id of a byte-level file."""
    return np.asarray(pc.binary_length(decoder(path)), np.int64)


@cache
def column_bpe(path: str) -> ColumnBPE:
    """One per worker process."""
    return ColumnBPE(path)
