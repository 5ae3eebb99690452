"""Byte-pair encoding and decoding by an index of where each pair stands."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.llm.common import remembered, texts

#: Texts of about so many bytes are indexed together; bounds of what a worker remembers, in each of two halves.
BYTES_AT_ONCE = 4 << 20
MOST_WORDS, LONGEST_WORD = 150_000, 64
#: White space as Unicode has it; `\s` of Python's engines counts four control characters more.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Pre-tokens of the public byte-level vocabulary, and the characters that stand for bytes in its file.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + "]+"
CUT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
SHOWN_AS_THEMSELVES = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))


def byte_characters() -> dict[str, int]:
    """Byte of each character of the vocabulary file: printable Latin-1 as itself, the rest in order from U+0100 on."""
    hidden = sorted(set(range(256)) - set(SHOWN_AS_THEMSELVES))
    return {chr(b): b for b in SHOWN_AS_THEMSELVES} | {chr(256 + i): b for i, b in enumerate(hidden)}


def vocabulary_file(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


class TokenBytes:
    """The bytes of each token of a byte-level vocabulary: all that decoding needs."""

    def __init__(self, spec: dict):
        of_char = byte_characters()
        as_bytes = lambda token: bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        known = {i: as_bytes(t) for t, i in spec["model"]["vocab"].items()} | {t["id"]: as_bytes(t["content"]) for t in spec["added_tokens"]}
        self.bytes_of = [known.get(i, b"") for i in range(max(known) + 1)]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for; what is no UTF-8 becomes U+FFFD, an id that is none is passed over."""
        numbers = np.frombuffer(ids, dtype="<u4")
        if len(numbers) and numbers.max() >= len(self.bytes_of):
            numbers = numbers[numbers < len(self.bytes_of)]
        raw = b"".join(map(self.bytes_of.__getitem__, numbers.tolist()))
        return raw.decode("utf-8", "replace").encode()


class BytePairs:
    """A byte-level vocabulary and its merges, for encoding many words at once."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        spec = vocabulary_file(path)
        added, vocabulary = spec["added_tokens"], spec["model"]["vocab"]
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")) or spec["normalizer"]:
            raise ValueError(f"{path}: only plain byte-level vocabularies without normalizer are known")
        of_char = byte_characters()
        self.special = {t["content"]: t["id"] for t in added}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.first = np.zeros(256, dtype=np.int64)
        for c, b in of_char.items():
            self.first[b] = vocabulary[c]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.left, self.right = [vocabulary[a] for a, _ in merges], [vocabulary[b] for _, b in merges]
        self.made = [vocabulary[a + b] for a, b in merges]
        self.ranks_before: dict[int, dict[int, int]] = {}
        self.ranks_after: dict[int, dict[int, int]] = {}
        for r, (a, b) in enumerate(zip(self.left, self.right)):
            self.ranks_before.setdefault(b, {})[a] = r  # of the symbols that b may stand behind
            self.ranks_after.setdefault(a, {})[b] = r  # and of those that may stand behind a
        born = dict.fromkeys(self.first.tolist(), -1) | {m: r for r, m in reversed(list(enumerate(self.made)))}
        if any(born.get(x, len(merges)) >= r for r in range(len(merges)) for x in (self.left[r], self.right[r])):
            raise ValueError(f"{path}: a merge comes before one that makes its parts, so ranks cannot be applied in ascending order")
        self.cut_known, self.cut_ascii = regex.compile(CUT).findall, re.compile(CUT_ASCII).findall
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.agreed: set[str] = set(map(chr, range(128)))
        self.special_ids = {i: i.to_bytes(4, "little") for i in self.special.values()}
        self.known: dict[str | int, bytes] = dict(self.special_ids)
        self.older: dict[str | int, bytes] = {}

    def index(self, symbols: np.ndarray, last: np.ndarray) -> dict[int, list[int]]:
        """Rank of each pair that can merge: the places where it begins, ascending. No pair reaches beyond a word's last symbol."""
        both = symbols[:-1] << 32 | symbols[1:]
        both[last[:-1]] = -1
        kinds, which = np.unique(both, return_inverse=True)
        ranks = np.array([self.ranks_after.get(k >> 32, {}).get(k & 0xFFFFFFFF, -1) for k in kinds.tolist()], dtype=np.int64)[which]
        places = np.flatnonzero(ranks >= 0)
        places = places[np.argsort(ranks[places], kind="stable")]
        found, starts = np.unique(ranks[places], return_index=True)
        return {r: p.tolist() for r, p in zip(found.tolist(), np.split(places, starts[1:]))} if len(found) else {}

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit numbers: the lowest rank that stands anywhere is applied everywhere.

        Every pair keeps a list of its places in all the words. A merge touches only the pairs on its two sides: their new
        places are appended, old ones are found dead when their list's turn comes. New pairs rank behind what made them
        (checked on loading), so each list is complete by then, and words end as if each were merged alone.
        """
        if not words:
            return []
        flat = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ends = np.cumsum([len(w) for w in words])
        last = np.zeros(len(flat), dtype=bool)
        last[ends[ends > 0] - 1] = True
        n = len(flat)
        places = self.index(flat, last) if n else {}
        symbol = [*flat.tolist(), -1]  # beyond the end stands a symbol that pairs with none
        after, before = list(range(1, n + 2)), list(range(-1, n))
        for e in (np.flatnonzero(last)).tolist():
            after[e] = n
            if e + 1 < n:
                before[e + 1] = n
        if n:
            before[0] = n
        active, none = sorted(places), {}
        while active:
            r = heapq.heappop(active)
            a, b, made = self.left[r], self.right[r], self.made[r]
            ahead, behind = self.ranks_before.get(made, none), self.ranks_after.get(made, none)
            for p in sorted(places.pop(r)):
                if symbol[p] != a:
                    continue
                q = after[p]
                if symbol[q] != b:
                    continue
                symbol[p], symbol[q] = made, -1
                z = after[q]
                after[p] = z
                before[z] = p
                y = before[p]
                k = ahead.get(symbol[y])
                if k is not None:
                    if k in places:
                        places[k].append(y)
                    else:
                        places[k] = [y]
                        heapq.heappush(active, k)
                k = behind.get(symbol[z])
                if k is not None:
                    if k in places:
                        places[k].append(p)
                    else:
                        places[k] = [p]
                        heapq.heappush(active, k)
        ids = np.array(symbol[:n], dtype=np.int64)
        alive = ids >= 0
        ids_bytes = ids[alive].astype("<u4").tobytes()
        upto = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])] * 4
        return [ids_bytes[i:j] for i, j in zip(upto[:-1].tolist(), upto[1:].tolist())]

    def by_library(self, text: str) -> list[str]:
        return [text[i:j] for _, (i, j) in self.library.pre_tokenize_str(text)]

    def cut(self, text: str) -> list[str]:
        """Pre-tokens as the public library has them. Its Unicode tables are older than those of the regex engine here:
        a text with a character that the two class differently is cut by the library, which is slower."""
        if text.isascii():
            return self.cut_ascii(text)
        new = set(text) - self.agreed
        self.agreed.update(c for c in new if self.cut_known(probe := f"a{c}1{c} {c}{c}a  {c}") == self.by_library(probe))
        return self.cut_known(text) if new <= self.agreed else self.by_library(text)

    def pre_tokens(self, text: str) -> list[str | int]:
        """Words to be merged, and ids of special tokens that stand in the text."""
        if self.at_special is None or not self.at_special.search(text):
            return self.cut(text)
        out: list[str | int] = []
        for piece in self.at_special.split(text):
            out.extend([self.special[piece]] if piece in self.special else self.cut(piece))
        return out

    def encode_texts(self, some: list[str]) -> Iterator[bytes]:
        """Ids of each text. Words seen before are remembered; of those the older half goes when the newer one is full."""
        if len(self.known) > MOST_WORDS:
            self.older, self.known = self.known, dict(self.special_ids)
        cut = [self.pre_tokens(t) for t in some]
        known, older = self.known, self.older
        fresh = set().union(*cut) - known.keys()
        again = fresh & older.keys()
        known.update(zip(again, map(older.__getitem__, again)))
        new = list(fresh - again)
        known.update(zip(new, self.encode_words([w.encode() for w in new])))
        for words in cut:
            yield b"".join(map(known.__getitem__, words))
        for w in new:
            if len(w) > LONGEST_WORD:
                del known[w]


def byte_pairs(path: str) -> BytePairs:
    """One for each Python worker; it lives on from task to task of an operator."""
    return remembered(("byte pairs", path), lambda: BytePairs(path))


def _encoded(path: str):
    def run(batches):
        model = byte_pairs(path)

        def out(ids: list, encoded: list[bytes]) -> pa.RecordBatch:
            counts = pa.array([len(e) // 4 for e in encoded], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), counts, pa.array(encoded, pa.binary())], names=["doc_id", "n_tokens", "ids"])

        for b in batches:
            held, some, size = [], [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                held.append(doc_id)
                some.append((text or b"").decode("utf-8", "replace"))
                size += len(some[-1])
                if size >= BYTES_AT_ONCE:
                    yield out(held, list(model.encode_texts(some)))
                    held, some, size = [], [], 0
            if held:
                yield out(held, list(model.encode_texts(some)))

    return run


def _decoded(path: str):
    def run(batches):
        model = remembered(("token bytes", path), lambda: TokenBytes(vocabulary_file(path)))
        for b in batches:
            decoded = pa.array([None if x is None else model.decode(x) for x in texts(b.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), decoded.cast(pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): each text's ids by the byte-level vocabulary at path, as little-endian unsigned 32-bit numbers.

    One pass without a shuffle. A task cuts some megabytes of texts into pre-tokens at a time and merges the distinct ones
    that its worker does not remember, all together, by the index of pairs (BytePairs.encode_words). A null text counts as
    empty and has no ids; invalid UTF-8 counts as U+FFFD; the string of a special token is that token, as in the public
    library. Rows stay as they are, repeated ones and null doc_ids too; an empty table gives none; other columns are ignored.
    """
    bare = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return bare.mapInArrow(_encoded(path), "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with `decoded`, the text that the ids stand for. Null ids give null."""
    bare = encoded.select("doc_id", "n_tokens", "ids")
    return bare.mapInArrow(_decoded(path), "doc_id long, n_tokens long, ids binary, decoded string")
