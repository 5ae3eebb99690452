"""Token counts by a unigram model, with scores shared along the prefixes of a trie."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.llm.common import remembered, texts

#: What the vocabulary puts before a pre-token.
START = "▁"
#: Words of the texts that share a trie, about; terminal counts that a worker remembers, in each of two halves, and the longest such word.
BATCH_WORDS = 400_000
REMEMBERED, LONGEST_WORD = 250_000, 64


class Unigrams:
    """Piece -> log probability: the public vocabulary's pieces in their order, by Zipf's law; any other byte a floor."""

    def __init__(self, pieces: Iterable[str]):
        pieces = [p for p in pieces if p]
        norm = math.log(sum(1 / r for r in range(1, len(pieces) + 2)))
        self.score: dict[str, float] = {}
        for rank, p in enumerate(pieces, 1):
            self.score.setdefault(p, -math.log(rank) - norm)
        #: Every end of a piece; None unless it is a piece itself.
        self.ends: dict[str, float | None] = {p[i:]: None for p in self.score for i in range(1, len(p))}
        self.ends.update(self.score)
        #: A byte that no piece covers costs more than any two pieces.
        self.byte = -3 * (math.log(len(pieces) + 1) + norm)


def unigrams(path: str) -> Unigrams:
    """The ordinary pieces of a vocabulary file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    return Unigrams(sp.id_to_piece(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))


def count_pre_tokens(words: Iterable[str], model: Unigrams) -> Iterator[tuple[str, int]]:
    """(pre-token, tokens of its best segmentation) for distinct pre-tokens.

    Sorted, the pre-tokens are a trie walked depth first: the path to a word is its common prefix with the word
    before, and the forward scores (best log probability, fewest tokens) of that prefix stand already. Only the path
    is held. Of segmentations with equal scores the one of fewer tokens counts.
    """
    ends, byte = model.ends, model.byte
    scores, counts, before = [0.0], [0], ""  # counts are negative, so that of equal scores the larger is better
    for word in sorted(words):
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del scores[shared + 1 :], counts[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            last = word[end - 1]
            n = 1 if last < "\x80" else len(last.encode("utf-8", "replace"))
            best, least = scores[end - 1] + n * byte, counts[end - 1] - n
            for start in range(end - 1, -1, -1):
                piece = word[start:end]
                if piece not in ends:  # nor does any longer one end a piece
                    break
                p = ends[piece]
                if p is not None:
                    s = scores[start] + p
                    if s > best or (s == best and counts[start] - 1 > least):
                        best, least = s, counts[start] - 1
            scores.append(best)
            counts.append(least)
        before = word
        yield word, -counts[len(word)]


class TerminalCounts(dict):
    """Tokens of a word (bytes), for the words that a worker has met lately; of two halves the older is given up."""

    def __init__(self, model: Unigrams):
        super().__init__()
        self.model, self.older = model, {}

    def learn(self, words: Iterable[bytes]) -> None:
        """Score what is new among distinct words, in one trie."""
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        new = []
        for w in words:
            if w not in self:
                n = self.older.get(w)
                if n is None:
                    new.append(w)
                else:
                    self[w] = n
        read = {START + w.decode("utf-8", "replace"): None for w in new}
        read.update(count_pre_tokens(read, self.model))
        self.update((w, read[START + w.decode("utf-8", "replace")]) for w in new)

    def forget_long(self, words: Iterable[bytes]) -> None:
        for w in words:
            self.pop(w, None)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(("token counts", path), lambda: TerminalCounts(unigrams(path)))
        for b in batches:
            words_of, tokens_of, some, held = [], [], [], 0

            def counted() -> None:
                distinct = set().union(*some)
                known.learn(distinct)
                words_of.extend(map(len, some))
                tokens_of.extend(sum(map(known.__getitem__, words)) for words in some)
                known.forget_long(w for w in distinct if len(w) > LONGEST_WORD)
                some.clear()

            for text in texts(b.column(1)):
                some.append((text or b"").split())
                held += len(some[-1])
                if held > BATCH_WORDS:  # whole texts, one at least
                    counted()
                    held = 0
            counted()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words_of, pa.int64()), pa.array(tokens_of, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of documents (doc_id, text), one row for each.

    Pre-tokens are words (runs of anything but ASCII white space) behind the vocabulary's start sign; a document has
    the tokens of all its pre-tokens, repeats included. Every task puts the pre-tokens that are new to its worker into
    a trie, batch by batch, and scores each shared prefix once; a worker remembers a bounded number of terminal counts
    from task to task. Nothing is shuffled, no word gathers anywhere, and a lost task is simply done again.

    A null or empty text has 0 of each; bytes that are no UTF-8 count as U+FFFD; repeated rows and null doc_ids stay; an empty table gives no rows; extra
    columns are ignored.
    """
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bare.mapInArrow(_count(vocabulary_path), "doc_id long, n_words long, n_tokens long")
