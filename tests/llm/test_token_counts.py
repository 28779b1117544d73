import random

import numpy as np
import pytest

from panelwright.llm import token_counts as T


def test_histogram_answers_match_the_documents(docs):
    texts = ["a b c", "hello world " * 50, None, "", "<|endoftext|> ordinary", "naïve 中文", "a b c", "x" * 300]
    table = docs([(k, t, "s") for k, t in enumerate(texts)], extra=("length", "docs"))
    lengths = np.array(T.encoded_lengths([t or "" for t in texts]))
    limits = T.limit_table(T.length_histogram(table))
    for r in limits.collect():
        assert r.docs == (lengths == r.length).sum() and r.docs_longer == (lengths > r.length).sum()
        assert r.tokens_longer == lengths[lengths > r.length].sum() and r.total_tokens == lengths.sum() and r.total_docs == len(texts)
        assert r.truncated_tokens == np.minimum(lengths, r.length).sum() and r.quantile == (lengths <= r.length).mean()
    for limit in (0, 1, 2, 4, 17, 10_000):
        assert T.truncated_total(limits, limit) == np.minimum(lengths, limit).sum()
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert T.length_quantile(limits, q) == np.sort(lengths)[max(0, int(np.ceil(q * len(lengths))) - 1)]


def test_round_trip_of_the_vocabulary():
    encoding = T._encoding(T.TOKENIZER, T.PATTERN)
    for t in ("plain", "é 中\n\n  x", "<|endoftext|>", "'s it's"):
        assert encoding.decode(encoding.encode_ordinary(t)) == t


SPACES = " \n\t\r\u00a0\u2003\u3000"


def test_long_white_space_changes_no_token():
    encoding = T._encoding(T.TOKENIZER, T.PATTERN)
    r = random.Random(2)
    for _ in range(60):
        runs = ["".join(r.choice(SPACES[: r.choice([1, 2, 7])]) for _ in range(r.choice([1, 2, 499, 500, 501, 700]))) for _ in range(3)]
        text = r.choice(["", "word", "é!"]) + runs[0] + r.choice(["word", "7", "...", "'s"]) + runs[1] + r.choice(["", "中文 x" + runs[2]])
        assert T.encoded_length(text) == len(encoding.encode_ordinary(text))
    assert T.encoded_length("a" + "\x1c" * 600 + "b") == len(encoding.encode_ordinary("a" + "\x1c" * 600 + "b"))


@pytest.mark.parametrize("piece", [" ", "\n", "x", "!", " \n\t", "ab ", "é"])
def test_texts_of_ten_million_characters(piece):
    n = 10_000_000 // len(piece)
    assert 0 < T.encoded_length(piece * n + "end") <= 10_000_003 * 2


def test_the_vocabulary_is_a_setting(spark, docs):
    spark.conf.set(T.TOKENIZER_SETTING, "/nowhere")
    try:
        with pytest.raises(Exception, match="nowhere"):
            T.length_histogram(docs([(1, "a", "s")])).collect()
        assert T.length_histogram(docs([(1, "a", "s")]), tokenizer=T.TOKENIZER).collect()[0].length == 1
    finally:
        spark.conf.unset(T.TOKENIZER_SETTING)


def test_empty_table(docs):
    limits = T.limit_table(T.length_histogram(docs([])))
    assert limits.count() == 0 and T.truncated_total(limits, 5) == 0 and T.length_quantile(limits, 0.5) is None
