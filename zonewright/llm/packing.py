"""Packing documents into sequences of a fixed length, online and in bounded space."""

from __future__ import annotations

import array
import bisect
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.functions.storage import materialize
from zonewright.llm.common import remembered, texts

LENGTH = 2048
OPEN_WINDOWS = 64
#: Leftovers of so many groups meet in one task of the next round.
GROUPS_A_MERGE = 64
END_ID = 1
#: Bounds the words that a worker remembers, in each of two halves, and their length.
MOST_WORDS, LONGEST_WORD = 250_000, 64
PIECES_A_BATCH = 2_000
#: Pieces side by side in a window are merged as one bundle until it has this share of the window.
BUNDLES_A_WINDOW = 32

PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary, part long, sequence_id long, offset long, bundle int"
NAMES = [x.split()[0] for x in PIECE.split(", ")]
ARROW = pa.schema([(n, {"ids": pa.binary(), "bundle": pa.int32()}.get(n, pa.int64())) for n in NAMES])
#: A bundle: the window and number it has, its tokens, and where it lies now.
BUNDLE = "window long, bundle int, tokens long, part long, sequence_id long, base long, closed boolean"


class WordIds(dict):
    """Ids of a word of bytes (no ASCII white space in it), as little-endian unsigned 32-bit numbers.

    White space parts pre-tokens, so a text's ids are those of its words, end to end. Words of plain Latin letters and
    ASCII need no normalising but lower case: their pre-tokens go to the model directly and are remembered too. Any
    other word takes the tokenizer's full path. Of what is remembered the older half goes when the newer one is full;
    a word in use comes over from the older half without being worked out again.
    """

    #: Letters whose lower case is one letter, and which composed form leaves alone.
    PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.bytes_of = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.older: dict[bytes, bytes] = {}
        self.pre_tokens: dict[str, bytes] = {}
        self.older_pre_tokens: dict[str, bytes] = {}
        # The pre-tokens of the public vocabulary file, for lower-case plain words.
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+").findall

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            if not self.PLAIN(text) or any(x in text for x in self.special):
                ids = packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
            elif text.isalpha():
                ids = self.of_pre_token(text.lower())
            else:
                ids = b"".join(map(self.of_pre_token, self.split(text.lower())))
        if len(word) <= LONGEST_WORD:
            self[word] = ids
        return ids

    def of_pre_token(self, x: str) -> bytes:
        ids = self.pre_tokens.get(x)
        if ids is None:
            ids = self.older_pre_tokens.get(x)
            if ids is None:
                plain = x if x.isascii() else "".join(s for s, _ in self.bytes_of.pre_tokenize_str(x))
                ids = packed([t.id for t in self.model.tokenize(plain)])
            if len(x) <= LONGEST_WORD:
                self.pre_tokens[x] = ids
        return ids

    def of_text(self, text: bytes | None) -> bytes:
        if len(self) > MOST_WORDS:
            self.older = dict(self)
            self.clear()
        if len(self.pre_tokens) > MOST_WORDS:
            self.older_pre_tokens, self.pre_tokens = self.pre_tokens, {}
        return b"".join(map(self.__getitem__, (text or b"").split()))


def packed(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if array.array("H", [1]).tobytes()[0] == 0:
        out.byteswap()
    return out.tobytes()


def word_ids(path: str) -> WordIds:
    """One for each Python worker; it lives on from task to task of packing."""
    return remembered(("word ids", path), lambda: WordIds(path))


class OpenWindows:
    """At most `most` open windows, kept by the space left in them."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.free: list[tuple[int, int]] = []  # (space, number), sorted
        self.held: dict[int, list] = {}
        self.opened = 0

    def place(self, piece: list, size: int) -> Iterator[tuple[int, list]]:
        """Put the piece where it fits best. Yields the windows that this closes."""
        at = bisect.bisect_left(self.free, (size, -1))
        if at < len(self.free):
            space, n = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                n = self.free.pop(0)[1]
                yield n, self.held.pop(n)
            space, n = self.length, self.opened
            self.opened, self.held[n] = n + 1, []
        self.held[n].append((piece, self.length - space))
        if space == size:
            yield n, self.held.pop(n)
        else:
            bisect.insort(self.free, (space - size, n))


def sequence_number(level: int, part: int, n: int) -> int:
    """Unlike for any two windows: 4 bits of level, 32 of part, 26 of number within the part."""
    return (level << 58) + (part << 26) + n


def bundled(sizes: Iterable[int], length: int) -> list[int]:
    """For pieces of these sizes, side by side in a window, the number of the bundle that each is in."""
    out, n, held = [], 0, 0
    for size in sizes:
        if held and held + size > length // BUNDLES_A_WINDOW:
            n, held = n + 1, 0
        out.append(n)
        held += size
    return out


def _pack_partition(path: str, length: int, most: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words, windows = TaskContext.get().partitionId(), word_ids(path), OpenWindows(length, most)
        end, rows = packed([END_ID]), []

        def rows_of(closed: Iterable[tuple[int, list]], is_closed: bool):
            for n, window in closed:
                bundles = [None] * len(window) if is_closed else bundled((size for (_, _, size, _, _), _ in window), length)
                for ((doc, start, size, of, ids), offset), bundle in zip(window, bundles):
                    rows.append((doc, start, size, of, ids, part, sequence_number(0, part, n), offset, bundle))

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=ARROW)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                ids = words.of_text(text) + end
                of = len(ids) // 4
                for start in range(0, of, length):
                    size = min(length, of - start)
                    rows_of(windows.place([doc, start, size, of, ids[4 * start : 4 * (start + size)]], size), True)
                    if len(rows) >= PIECES_A_BATCH:
                        yield batch()
        for window in sorted(windows.held.items()):
            rows_of([window], False)
            if len(rows) >= PIECES_A_BATCH:
                yield batch()
        if rows:
            yield batch()

    return pack


def merged(bundles: list[tuple], length: int, still_open: int) -> list[tuple[int, int, bool]]:
    """(window, offset, whether it is closed) for bundles of (tokens, ...): the largest first, each where it fits best.

    Bundles of the same size go by the rest of their tuples. The still_open emptiest windows stay open.
    """
    order = sorted(range(len(bundles)), key=lambda i: (-bundles[i][0], *bundles[i][1:]))
    windows, done = OpenWindows(length, len(bundles)), []
    for i in order:
        done += windows.place([i], bundles[i][0])
    left = {n for _, n in windows.free[len(windows.free) - still_open :]} if still_open else set()
    out: list = [None] * len(bundles)
    for n, window in [*done, *windows.held.items()]:
        for (i,), offset in window:
            out[i] = (n, offset, n not in left)
    return out


def _merge_group(length: int, most: int, level: int, last: bool):
    def merge(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        """One group's bundles, placed anew."""
        placed = merged(list(zip(b["tokens"], b["window"], b["bundle"])), length, 0 if last else most)
        numbers, base, closed = zip(*placed)
        return b.assign(sequence_id=[sequence_number(level, int(key[0]), n) for n in numbers], base=base, closed=closed)

    return merge


def pack_documents(docs: DataFrame, tokenizer_path: str, *, length: int = LENGTH, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """The pieces of all documents (doc_id, text) in sequences of at most `length` token ids.

    Each partition packs online: it holds at most open_windows open windows, puts a piece into the one where it fits
    best, and closes the fullest when none fits. Documents are cut at multiples of `length` only. What stays open at a
    partition's end is merged, so many groups at a time, until one group is left; every round hands on at most
    open_windows windows a group, so no task's share grows with the input. Merging works on bundles of pieces (a
    window has about twice BUNDLES_A_WINDOW at most) by their number of tokens; the ids stay where they are stored.

    A null text is empty: such a document is its end id alone. Ids are those that the tokenizer gives of itself, so a
    special token's string becomes that token; bytes that are no UTF-8 count as U+FFFD. Null and repeated doc_ids and
    repeated rows are packed like others; an empty table gives no rows; extra columns are ignored. Returns doc_id,
    start, length, doc_tokens, ids (binary, little-endian unsigned 32-bit), sequence_id and offset, one row a piece.
    """
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = materialize(bare.mapInArrow(_pack_partition(tokenizer_path, length, open_windows), PIECE), "pack-0")
    left = first.filter("bundle IS NOT NULL")
    by = ["part", F.col("sequence_id").alias("window"), "bundle"]
    still = left.groupBy(*by).agg(F.sum("length").alias("tokens"))
    starts = left.groupBy(F.col("sequence_id").alias("window"), "bundle").agg(F.min("offset").alias("first"))
    level, parts, placed = 0, left.agg(F.max("part")).first()[0], None
    while parts is not None:
        level, parts = level + 1, parts // GROUPS_A_MERGE
        grouped = still.select("window", "bundle", "tokens", F.expr(f"part div {GROUPS_A_MERGE}").alias("part")).groupBy("part")
        merge = _merge_group(length, open_windows, level, parts == 0)
        round_ = materialize(grouped.applyInPandas(merge, BUNDLE), f"pack-{level}")
        closed, still = round_.filter("closed"), round_.filter("not closed")
        placed = closed if placed is None else placed.unionByName(closed)
        if parts == 0:
            break
    out = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    done = first.filter("bundle IS NULL").select(*out)
    if placed is None:
        return done
    moved = placed.join(starts, ["window", "bundle"]).select(F.col("window").alias("_window"), F.col("bundle").alias("_bundle"), F.col("sequence_id").alias("_to"), (F.col("base") - F.col("first")).alias("_by"))
    here = left.join(moved, (F.col("sequence_id") == F.col("_window")) & (F.col("bundle") == F.col("_bundle")))
    return done.unionByName(here.withColumn("sequence_id", F.col("_to")).withColumn("offset", F.col("offset") + F.col("_by")).select(*out))
