import math
import random

from tests.llm.helpers import TEXTS, awkward, empty, words
from zonewright.llm.common import PIECE_VOCABULARY, tokenizer_file
from zonewright.llm.token_counts import START, Unigrams, count_pre_tokens, token_counts, unigrams


def brute(word: str, model: Unigrams) -> int:
    """Viterbi of one pre-token on its own, position by position."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            if word[start:end] in model.score:
                options.append((best[start][0] + model.score[word[start:end]], best[start][1] - 1))
        n = len(word[end - 1].encode())
        options.append((best[end - 1][0] + n * model.byte, best[end - 1][1] - n))
        best[end] = max(options)
    return -best[-1][1]


def test_shared_prefixes_give_what_each_word_gives_alone():
    model, rng = unigrams(tokenizer_file(PIECE_VOCABULARY)), random.Random(3)
    some = {START + "".join(rng.choice("abcdeé日 th") for _ in range(rng.randrange(9))) for _ in range(800)}
    got = dict(count_pre_tokens(some, model))
    assert got == {w: brute(w, model) for w in some}
    tiny = Unigrams([START, "a", "b", "ab", START + "a"])
    assert dict(count_pre_tokens({START + "ab", START + "abab", START + "é"}, tiny)) == {w: brute(w, tiny) for w in (START + "ab", START + "abab", START + "é")}


def test_documents_against_brute_force(spark, sf_dir):
    path = tokenizer_file(PIECE_VOCABULARY)
    model = unigrams(path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known: dict[str, int] = {}
    for r in token_counts(docs, path).join(docs, "doc_id").collect():
        w = words(r.text)
        for x in w:
            if x not in known:
                known[x] = brute(START + x, model)
        assert (r.n_words, r.n_tokens) == (len(w), sum(known[x] for x in w))


def test_awkward_rows(spark):
    got = sorted((str(r.doc_id), r.n_words) for r in token_counts(awkward(spark), tokenizer_file(PIECE_VOCABULARY)).collect())
    assert got == sorted((str(i), len(words(t))) for i, t, _, _ in TEXTS)
    assert token_counts(empty(spark), tokenizer_file(PIECE_VOCABULARY)).count() == 0
